"""Annotation analytics on Spark: DataFrame operators for nested UI documents, strokes, boxes, prompts and their scores."""
