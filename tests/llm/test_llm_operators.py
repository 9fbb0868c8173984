"""The operators against brute force on small tables: nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from annomill.llm import bitplane, chat, decontam, line_dedup, merkle, packing, simhash, substring, tokens, toxicity, warc
from annomill.llm.textkit import sliding, window_hashes, word_hashes, word_spans

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
RNG = np.random.default_rng(1)
VOCABULARY = [f"w{i}" for i in range(300)]


def prose(n: int, rng=RNG) -> str:
    return " ".join(VOCABULARY[i] for i in rng.integers(0, len(VOCABULARY), n))


PASSAGE = prose(60)
LONG = prose(30_000)
ROWS = [
    (1, PASSAGE + " tail one"),
    (2, "head two\t" + PASSAGE.replace(" ", "\n", 3)),
    (3, None),
    (4, ""),
    (5, "short"),
    (6, "Short"),
    (None, prose(50)),
    (7, LONG),
    (8, "one two " * 40),
    (9, "é日本 ünï\n\n \x0b x"),
    (10, PASSAGE + " tail one"),
    (10, PASSAGE + " tail one"),
    (11, "l1\nl2\nl3\nl4"),
    (12, "l0\nl1\nl2\nl3"),
    (13, "  \n \n  "),
]
SCHEMA = "doc_id long, text string, h long, chunk int, fp string, bucket int, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, 1, 2, "x", 3, "en") for d, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(text):
    return (text or "").encode().split()


def test_window_hashes_tell_word_runs_apart():
    texts = [b"a b  c d", b"x a b\tc d", b"", b"ab c d"]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    starts, ends, counts = word_spans(data, at)
    assert counts.tolist() == [4, 5, 0, 3]
    h = window_hashes(word_hashes(data, starts, ends), 4)
    assert h[0] == h[5] and len(set(h.tolist())) == len(h) - 1
    x = RNG.integers(0, 100, 50)
    for width in (1, 2, 5, 8, 50):
        assert sliding(x, width).tolist() == [x[i : i + width].min() for i in range(51 - width)]
    assert sliding(x, 51).tolist() == []


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_tokens_are_the_library_s(path):
    e = tokens.Encoder(path)
    odd = ["", " ", "\n", "a  b", " a b ", "don't it's' LL's", "<|endoftext|> x", "É'é ª µ×÷ß x1y2 12", "\x1c a\x1cb", "a ́b", "İ ẞ ΣΣ", "\0 a\0b", "漢字 kanji。", "x\r\ny\x85", "²³ ¼½", "a\xa0b \xa0 c", "\xad­x", "   x   y\n\n  z  ", LONG]
    assert [t for t in odd if e.ids(t) != e.whole(t)] == []


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_bitplane_round_trip(spark, docs, none, planes):
    found = bitplane.write_and_read(docs, WORD, 2, planes=planes, block=1000, file_ids=5000).orderBy("start").collect()
    e, want, start = tokens.Encoder(WORD), [], 0
    for d, ids in sorted(((d, np.append(np.frombuffer(e.whole(t or ""), "<u2"), 2).astype("<u4")) for d, t in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1].astype("<u2").tobytes())):
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in found] == want
    assert bitplane.write_and_read(none, WORD, 2).count() == 0
    ids = RNG.integers(0, 1 << 16, 777).astype("<u2")
    data = bitplane.pack_file(ids, np.zeros(0, bitplane.DOC), {"shard": 0, "part": 0}, 100, planes, 3)
    about = bitplane.footer(data)
    assert np.concatenate([bitplane.read_block(data, about, b) for b in range(8)]).tolist() == ids.tolist()


def test_substring_removal(docs, none):
    texts = [words(t) for _, t in ROWS]
    seen = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    want = []
    for (d, _), w in zip(ROWS, texts, strict=True):
        off = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                off[i : i + 35] = [True] * 35
        kept = b" ".join(x for x, o in zip(w, off, strict=True) if not o)
        want.append((d, len(w), sum(off), hashlib.sha256(kept).hexdigest()))
    assert rows(substring.dedup(docs, text=False)) == sorted(want, key=repr)
    assert sum(r[2] for r in want) > 300
    assert substring.dedup(none).count() == 0
    assert substring.levels(35) == [9, 18, 35]


def brute_print(text, shingle=4):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark, docs, none):
    base = prose(200).split()
    near = []
    for k in range(120):
        w = list(base)
        for i in RNG.integers(0, len(w), k % 5):
            w[i] = "z"
        near.append((100 + k, " ".join(w)))
    data = [(d, t) for d, t in ROWS if d != 7] + near
    table = spark.createDataFrame(data, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("root", F.lit("r"))
    prints = [brute_print(t) for _, t in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(data):
        if d is not None:
            r = find(i)
            least[r] = d if least[r] is None else min(least[r], d)
    want = sorted(((d, f"{p:016x}", least[find(i)]) for i, ((d, _), p) in enumerate(zip(data, prints, strict=True))), key=repr)
    found = simhash.near_duplicates(table).select("doc_id", F.lower(F.hex("fp")), "component_id")
    assert rows(found) == want
    assert simhash.near_duplicates(none).count() == 0


def test_trie_walk_finds_all_pairs():
    for bits, n in ((0, 1), (1, 1), (3, 1 << 20), (4, 1), (4, 1 << 24), (4, 1 << 30), (4, 1 << 36), (6, 1 << 22)):
        base = RNG.integers(0, 1 << 63, 150, dtype=np.uint64)
        flips = np.array([sum(1 << int(b) for b in RNG.choice(64, k % 8, replace=False)) for k in range(150)], np.uint64)
        leaves = np.unique(np.concatenate([base, base ^ flips]))
        plan = simhash.exact(bits, n)
        found = set()
        for trie, order in enumerate(plan.orders):
            keys = simhash._keys(leaves.reshape(-1, 1), order)
            at = np.argsort(keys)
            for node in np.unique(keys >> np.uint64(64 - plan.depth)) if plan.depth else [0]:
                own = at[keys[at] >> np.uint64(64 - plan.depth) == node] if plan.depth else at
                forest = simhash.Forest(len(own))
                simhash.walk(keys[own], leaves[own].reshape(-1, 1), plan, trie, forest)
                found |= {(int(own[i]), int(own[g])) for i, g in enumerate(forest.group) if i != g}
        root = simhash.Forest(len(leaves))
        if found:
            root.add(*np.array(sorted(found)).T)
        want = simhash.Forest(len(leaves))
        want.add(*np.nonzero(np.bitwise_count(leaves[:, None] ^ leaves[None, :]) <= bits))
        assert (root.group == want.group).all()
        assert len(plan.orders) == {1: 5, 1 << 24: 5, 1 << 30: 15, 1 << 36: 35}.get(n if bits == 4 else 0, len(plan.orders))


def test_tries_follow_the_number_of_leaves():
    for n in (100, 10**5, 10**7, 10**9):
        plan = simhash.similar(0.8, n)
        assert simhash.met(0.8, plan.depth, len(plan.orders)) >= 0.95 and n / 2**plan.depth <= simhash.NODE
        assert len(plan.orders) <= 3 * max(1, n / simhash.NODE) ** 0.35


def test_deduplicate_keeps_one_of_each_group(spark, none):
    base = prose(300).split()
    data = [(1, " ".join(base)), (2, " ".join(base)), (2, " ".join(base)), (3, " ".join([*base[:150], "other", *base[151:]])), (4, prose(300)), (None, prose(20)), (None, prose(21)), (5, None), (6, "")]
    kept = simhash.deduplicate(spark.createDataFrame(data, "doc_id long, text string").withColumn("lang", F.lit("en")))
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 4, 5, None, None]
    assert simhash.deduplicate(none).count() == 0


def edit_to(words, similarity, rng):
    """A copy whose five-word shingles have about this similarity: single words replaced until it is reached from above."""
    out = list(words)
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    one = sets(words)
    for i in rng.permutation(len(out)):
        before, out[i] = out[i], f"new{rng.integers(1 << 30)}"
        two = sets(out)
        if len(one & two) / len(one | two) < similarity:
            out[i] = before
            return out, len(one & sets(out)) / len(one | sets(out))
    return out, 0.0


@pytest.mark.parametrize("node", [1 << 13, 64])
def test_similar_texts_are_found_and_others_left_alone(spark, monkeypatch, node):
    """Recall at the stated similarity is at least 0.9, and no pair below it is linked, also where nodes are small and tries many."""
    monkeypatch.setattr(simhash, "NODE", node)
    rng, data, n = np.random.default_rng(3), [], 150
    levels = {}
    for k in range(n):
        w = prose(int(rng.integers(60, 400)), rng).split()
        v, s = edit_to(w, (0.70, 0.75, 0.8, 0.85)[k % 4], rng)
        levels[2 * k + 1] = s
        data += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(2 * k in kept for k in range(n))
    assert all(d in kept for d, s in levels.items() if s < 0.8)
    for low, high in ((0.8, 0.85), (0.85, 1.0)):
        here = [d for d, s in levels.items() if low <= s < high]
        assert len(here) > 25 and sum(d not in kept for d in here) >= 0.9 * len(here)


def test_near_copies_in_a_large_group(spark, monkeypatch):
    """Nodes beyond MOST are cut into salts, and no link is lost."""
    monkeypatch.setattr(simhash, "MOST", 64)
    rng = np.random.default_rng(4)
    base = prose(200, rng).split()
    data = []
    for k in range(400):
        w = list(base)
        w[int(rng.integers(200))] = f"new{k}"
        data.append((k, " ".join(w)))
    data += [(1000 + k, prose(100, rng)) for k in range(50)]
    table = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicate(table).collect()) == [0, *range(1000, 1050)]
    one = rows(simhash.near_duplicates(table))
    monkeypatch.setattr(simhash, "MOST", 1 << 15)
    assert one == rows(simhash.near_duplicates(table))


M64 = (1 << 64) - 1


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def plain_digest(values, base):
    total = sum((v + 1) * pow(base, i, 1 << 64) for i, v in enumerate(values))
    return plain_mix((total + len(values) * 0x2545F4914F6CDD1D) & M64)


def plain_merkle(text):
    """The fingerprint by plain loops over nodes (place, length, digest, children)."""
    zeros = lambda h, most: min(most, (h & -h).bit_length() - 1 if h else 64)
    x = [plain_mix(ord(c) + 1) for c in text]
    strength = [zeros(plain_mix((x[i] + sum(x[i - k] * (2 * k + 1) for k in (1, 2, 3) if k <= i)) & M64), 15) for i in range(len(x))]
    begin = 0
    for i in range(len(x)):
        if i + 1 == len(x) or (text[i] == "\n" and text[i + 1] != "\n"):
            strength[i] = 16 + zeros(plain_digest(x[begin : i + 1], merkle.BYTE_BASE), 7)
            begin = i + 1
    nodes = [(i, 1, v, []) for i, v in enumerate(x)]
    for k in range(1, 25):
        groups, now = [], []
        for node in nodes:
            now.append(node)
            last = node[0] + node[1] == len(x)
            if last or k < 24 and strength[node[0] + node[1] - 1] >= k:
                groups.append(now)
                now = []
        if k not in (16, 24):
            groups = [part for g in groups for part in ([g[i : i + 4] for i in range(0, len(g), 4)] if len(g) > 8 else [g])]
        merged = [g[0] if len(g) == 1 else (g[0][0], sum(n[1] for n in g), plain_digest([n[2] for n in g], merkle.WORD_BASE), g) for g in groups]
        nodes = [(*n[:3], []) for n in merged] if k == 1 else merged
    tops = nodes

    def kept(node, grain):
        leaf = not node[3] or node[1] <= 1 << grain
        return [(node[1], leaf, node[2])] + ([] if leaf else [y for c in node[3] for y in kept(c, grain)])

    grain = next(g for g in range(64) if sum(leaf for t in tops for _, leaf, _ in kept(t, g)) <= 64)
    found = [y for t in tops for y in kept(t, grain)]
    wide = len(text) >= 1 << 15
    size = np.array([n << 1 | leaf for n, leaf, _ in found], "<u4" if wide else "<u2").tobytes()
    digests = np.array([d & 0xFFFF for _, _, d in found], "<u2").tobytes()
    second = plain_digest([ord(c) for c in text], merkle.BYTE_BASE ^ 0x5DEECE66C)
    top = tops[0][2] if tops else 0
    root = hashlib.blake2b(top.to_bytes(8, "little") + second.to_bytes(8, "little") + len(text).to_bytes(8, "little"), digest_size=16).digest()
    plain = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    return plain(root) + "." + plain(bytes([grain, wide]) + size + digests)


def plain_edit(text, following):
    n = len(text) // 4
    return (text[:-n] if n else text) + following[:n]


MERKLE_TEXTS = ["", "a", "ab", "\n", "\n\n a\n", "éé日本 x", "short text", "And " * 500, "one line\n" * 90, prose(12), prose(40), "\n".join(prose(9) for _ in range(40)), prose(300) + "\n\n" + prose(5)]


def test_merkle_fingerprints_against_plain_loops():
    assert merkle.fingerprints(MERKLE_TEXTS) == [plain_merkle(t) for t in MERKLE_TEXTS]
    assert merkle.fingerprints(MERKLE_TEXTS[::-1])[::-1] == [merkle.fingerprints([t])[0] for t in MERKLE_TEXTS]
    assert max(len(f) for f in merkle.fingerprints([LONG, "x" * 100_000, "x\n" * 50_000])) < 3000


def test_merkle_pairs(docs, none):
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    prints = {t or "": plain_merkle(t or "") if len(t or "") < 10_000 else merkle.fingerprints([t])[0] for _, t in ROWS}
    want = []
    for (d, t), (_, x) in zip(order, order[1:] + order[:1], strict=True):
        t, x = t or "", x or ""
        e = plain_edit(t, x)
        f = plain_merkle(e) if len(e) < 10_000 else merkle.fingerprints([e])[0]
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), prints[t], f))
    found = merkle.pairs(docs).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(want, key=repr)
    by_print = {}
    for (d, t), (_, x) in zip(order, order[1:] + order[:1], strict=True):
        by_print[prints[t or ""]] = (t or "", x or "")
    for r in found:
        t, x = by_print[r.fingerprint]
        e = plain_edit(t, x)
        assert (r.near_edited == 1) == (t == e)
        if len(t) > 200 and len(e) == len(t):  # about the share of code points left as they were
            assert abs(r.near_edited - 0.75) < 0.12
    assert merkle.pairs(none).count() == 0


def test_merkle_likeness_is_the_common_share():
    rng = np.random.default_rng(11)
    for n in (8, 30, 100, 400, 3000):
        w = prose(n, rng).split()
        for share in (0.1, 0.5, 0.9):
            k = int(n * share)
            other = w[:k] + prose(n - k, rng).split()
            one, two = "\n".join(" ".join(x) for x in (w[: n // 2], w[n // 2 :])), "\n".join(" ".join(x) for x in (other[: n // 2], other[n // 2 :]))
            same = next((i for i, (p, q) in enumerate(zip(one, two, strict=False)) if p != q), min(len(one), len(two))) / max(len(one), len(two))
            assert abs(merkle.likeness(*merkle.fingerprints([one, two])) - same) < 0.2
    assert all(merkle.likeness(*merkle.fingerprints([prose(50, rng), prose(50, rng)])) < 0.2 for _ in range(50))


def test_merkle_trees_locate_edits():
    lines = [prose(40) for _ in range(30)]
    text = "\n".join(lines)
    begin = sum(len(x) + 1 for x in lines[:12])
    end = begin + len(lines[12])
    lines[12] = prose(40)
    other = "\n".join(lines)
    for one, two in ((text, other), (other, text)):
        left, right = merkle.differing(*(merkle.Tree(x) for x in merkle.fingerprints([one, two])))
        assert left and right and min(i for i, _ in left) >= begin - 200
        assert max(j for _, j in left) <= end + 400 and max(j for _, j in right) <= end + 400
    one, same, other = merkle.fingerprints(["a b", "a b", "a  b"])
    assert one == same != other and merkle.likeness(one, same) == 1.0 and merkle.likeness(one, other) < 1
    assert merkle.likeness(*merkle.fingerprints(["", "x"])) == 0.0 and merkle.likeness(*merkle.fingerprints(["", ""])) == 1.0


def test_chat_paths_and_round_trip(spark):
    tree = [("t", 1, None, "user", "q", 1.0), ("t", 2, 1, "assistant", "bad", 0.0), ("t", 3, 1, "assistant", "good", 5.0), ("t", 4, 3, "user", None, 1.0), ("t", 5, 4, "assistant", "end", None), ("t", 6, 99, "user", "orphan", 0.0), ("c", 1, 2, "user", "circle", 1.0), ("c", 2, 1, "user", "circle", 1.0)]
    m = spark.createDataFrame(tree, "tree_id string, node_id long, parent_id long, role string, text string, score double")
    found = {(r.leaf, r.rank): chat.parse_turns(r.text) for r in chat.conversations(m, keep=3).collect()}
    assert found == {(5, 1): [("user", "q"), ("assistant", "good"), ("user", ""), ("assistant", "end")], (2, 2): [("user", "q"), ("assistant", "bad")], (6, 3): [("user", "orphan")]}
    assert chat.conversations(m.limit(0)).count() == 0
    chain = spark.createDataFrame([("x", k, k - 1 or None, "user", str(k), 1.0) for k in range(1, 40)], m.schema)
    assert [len(chat.parse_turns(r.text)) for r in chat.conversations(chain).collect()] == [39]


@pytest.mark.parametrize("text", ["", "\\", "<|end|>\n", "<|turn|>user\nx<|end|>\n", "\\### Assistant: </turn> ok", "\\<|", "<<||", "\\n", "a\\\\<|b"])
def test_chat_escapes_are_reversible(text):
    turns = [("user", text), (text, text), ("assistant", text)]
    out, spans = chat.format_turns(turns)
    assert chat.parse_turns(out) == turns
    assert [chat.unescape(out[i:j]) for i, j in spans][-1] == text


def test_chat_read_back(spark):
    data = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, 2, None, "\\<|"), (2, 5, "assistant", "é日")]
    r = {x.tree_id: x for x in chat.read_back(chat.conversations(chat.linear(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert r[1].n_turns == 4 and r[1].turns_sha256 == sha("user\na\nassistant\n\nassistant\n\n\n\\<|\n") and r[1].loss_chars == 0
    assert (r[2].loss_chars, r[2].loss_sha256) == (2, sha("é日"))


def test_chat_keeps_a_null_conversation(spark):
    data = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 0, "user", "c")]
    found = chat.conversations(chat.linear(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))).collect()
    assert {r.tree_id: chat.parse_turns(r.text) for r in found} == {None: [("user", "a"), ("assistant", "b")], 1: [("user", "c")]}


def test_warc_revisits(spark):
    big = "x" * 100
    data = [(1, "http://a", big), (2, "http://b", big), (3, None, None), (4, "u\r\nv", ""), (5, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"), (None, "n", big), (6, "u", "é" * 50), (5, "u", "other")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("of", F.lit(1))
    for least in (0, 60):
        largest = {}
        for p, _, h in data:
            largest[h or ""] = max(largest.get(h or "", -1), -1 if p is None else p)
        want = []
        for p, _, h in data:
            b, m = (h or "").encode(), largest[h or ""]
            revisit = len(b) >= least and m != p
            want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", m if revisit else None, None if revisit else bytearray(b)))
        assert rows(warc.write_and_read(pages, least=least)) == sorted(want, key=repr)
    assert warc.write_and_read(pages.limit(0)).count() == 0


def test_warc_members_are_plain_gzip():
    import gzip

    huge = warc.record(1, "u", b"\0" * (17 << 20), "response", None, "d")
    assert huge[-1] == 0 and gzip.decompress(huge).endswith(b"\r\n\r\n")
    assert [len(b) for _, b in warc.records_of(huge + warc.record(2, "v", b"abc", "response", None, "d"))] == [17 << 20, 3]


def test_packing_is_a_partition(docs, none):
    found = packing.pack(docs, BYTE, 0, size=64, with_ids=True).collect()
    e = tokens.Encoder(BYTE)
    want = Counter((d, np.append(np.frombuffer(e.whole(t or ""), "<u2"), 0).astype("<u2").tobytes()) for d, t in ROWS)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        assert r.ids_crc32 == zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes())
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        total = sum(r.length for r in s)
        assert [r.offset for r in s] == np.cumsum([0, *(r.length for r in s)])[:-1].tolist() and total <= 64 and total & (total - 1) == 0
    for d in {d for d, _ in ROWS}:
        texts = [t for (x, t), n in want.items() if x == d for _ in range(n)]
        assert sum(map(len, texts)) == 2 * sum(r.length for r in pieces[d])
        if len(texts) == 1:
            assert b"".join(r.ids for r in sorted(pieces[d], key=lambda r: r.start)) == texts[0]
    assert packing.pack(none, BYTE, 0).count() == 0


def test_packing_puts_neighbours_together():
    topic = [np.arange(1000 * k + 1, 1000 * k + 40, dtype="<u2") for k in range(4)]
    blobs = [np.append(RNG.permutation(topic[i % 4])[:30], 0).astype("<u2").tobytes() for i in range(40)]
    df = np.bincount(np.concatenate([np.unique(np.frombuffer(b, "<u2")) for b in blobs]), minlength=1 << 16)
    index = packing.Index(blobs, df, 40, 31.0, 0.5)
    seen = defaultdict(set)
    for d, _, _, sequence, _ in packing.order_and_cut(index, 31 * 10):
        seen[sequence].add(d % 4)
    assert sum(len(s) for s in seen.values()) == 4


def test_packing_finds_neighbours_among_all_documents(spark):
    rng = np.random.default_rng(5)
    data = []
    for k in range(2000):  # 40 topics of 50 documents; a random shard of 100 holds two or three of each
        own = rng.integers(0, 25, 40) + 25 * (k % 40)
        data.append((k, " ".join(f"{chr(97 + w % 26)}{chr(97 + w // 26 % 26)}{chr(97 + w // 676)}q{w}" for w in own)))
    table = spark.createDataFrame(data, "doc_id long, text string").repartition(8)

    def packed():
        return sorted((r.sequence_id, r.offset, r.doc_id, r.length) for r in packing.pack(table, BYTE, 0, shard_docs=100).collect())

    found = packed()
    topics, shards = defaultdict(Counter), Counter()
    for sequence, _, doc, length in found:
        topics[sequence][doc % 40] += length
        shards[sequence >> 32] += length
    assert sum(max(c.values()) for c in topics.values()) > 0.7 * sum(r[3] for r in found)
    assert len(shards) == 20 and max(shards.values()) < 2 * sum(shards.values()) / 20
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert packed() == found
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_packing_splits_a_hot_cell(spark):
    table = spark.createDataFrame([(k, "one text") for k in range(1000)], "doc_id long, text string")
    shards = Counter(r.sequence_id >> 32 for r in packing.pack(table, BYTE, 0, size=64, shard_docs=100).select("doc_id", "sequence_id").distinct().collect())
    assert len(shards) == 10 and max(shards.values()) < 200


def test_decontamination_finds_edited_copies(spark, docs, none):
    items = [(k, prose(40)) for k in range(20)] + [(20, "tiny item"), (21, ""), (22, None), (None, prose(30))]
    leaks = []
    for k in range(20):
        w = items[k][1].split()
        for i in RNG.choice(40, k % 8, replace=False):
            w[i] = "edit"
        leaks.append((1000 + k, prose(100) + ", " + " ".join(w).upper() + "! " + prose(50)))
    clean = [(2000 + k, prose(400)) for k in range(30)]
    table = spark.createDataFrame([(d, t) for d, t in ROWS + leaks + clean + [(3000, "a Tiny, item.")]], "doc_id long, text string").withColumn("item", F.lit(1))
    found = {(r.doc_id, r.item_id): r for r in decontam.matches(table, spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(0))).collect()}
    assert set(found) == {(1000 + k, k) for k in range(20)} | {(3000, 20)}
    assert (found[(1000, 0)].first_word, found[(1000, 0)].last_word, found[(1000, 0)].score) == (100, 139, 1.0)
    left = decontam.decontaminate(table, spark.createDataFrame(items, "item_id long, text string"))
    assert left.count() == len(ROWS) + 30 and left.columns == table.columns
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.matches(none, empty).count() == 0 and decontam.decontaminate(docs, empty).count() == len(ROWS)


def test_decontamination_finds_parts_of_an_item_that_is_copied_often(spark):
    rng = np.random.default_rng(7)
    item = prose(40, rng).split()
    broken = [w if i >= 20 or i % 4 < 3 else "edit" for i, w in enumerate(item)]  # no four words in a row left in the first half
    data = [(k, prose(30, rng) + " " + " ".join(item)) for k in range(150)]
    data += [(200, prose(30, rng) + " " + " ".join(item[:20])), (201, prose(30, rng) + " " + " ".join(item[20:])), (202, " ".join(broken)), (203, prose(400, rng)), (204, " ".join(item[:10]))]
    found = {r.doc_id: r.score for r in decontam.matches(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert set(found) == {*range(150), 200, 201, 202}
    assert found[0] == 1.0 and found[200] >= 0.5 and found[201] >= 0.5


def test_decontamination_seeds_are_rare_where_a_stretch_has_anything_rare(spark):
    rng = np.random.default_rng(11)
    phrase = "choose the best answer from the options listed below"
    items = [(k, f"{prose(12, rng)} {phrase} {prose(15, rng)}") for k in range(30)] + [(40, phrase), (41, "a b"), (42, ""), (None, f"{phrase} x y"), (43, "same words in two items here"), (44, "same words in two items here")]
    table = spark.createDataFrame(items, "item_id long, text string")
    plain = {k: decontam.text_words(t) for k, t in items}
    texts = table.select(F.col("item_id").alias("item"), F.xxhash64("text").alias("mark"), "text").distinct()
    found = {}
    for r in decontam.rare(decontam.item_grams(texts, 4), 4, 0.5).collect():
        found.setdefault(r.item, set()).add(r.place)
    grams = {k: [tuple(w[i : i + 4]) for i in range(len(w) - 3)] or [tuple(w)] for k, w in plain.items() if len(w)}
    holders = {}
    for k, gs in grams.items():
        for g in gs:
            holders.setdefault(g, set()).add(dict(items)[k])
    for k, gs in grams.items():  # each stretch of half the words, its rarest n-grams
        often, width = [len(holders[g]) for g in gs], min(len(gs), max(1, -(-len(plain[k]) // 2) - 3))
        wanted = {j for i in range(len(gs) - width + 1) for j in range(i, i + width) if often[j] == min(often[i : i + width])}
        assert found.pop(k) == wanted, k
    assert not found
    phrases = decontam.rare(decontam.item_grams(texts.filter("item < 30"), 4), 4, 0.5).filter("place BETWEEN 12 AND 17")
    assert phrases.count() == 0


def test_decontamination_with_a_phrase_that_all_share(spark):
    rng = np.random.default_rng(12)
    phrase = "choose the best answer from the options listed below"
    items = [(k, f"{prose(12, rng)} {phrase} {prose(15, rng)}") for k in range(80)]
    data = [(k, f"{prose(100, rng)} {phrase} {prose(60, rng)}") for k in range(200)]
    data += [(1000 + k, f"{prose(50, rng)} {items[k][1]} {phrase}") for k in range(70)] + [(2000, " ".join(t for _, t in items[:70]))]
    found = decontam.matches(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.score == 1.0} == {(1000 + k, k) for k in range(70)} | {(2000, k) for k in range(70)}
    assert all(r.doc_id >= 1000 for r in found)


def test_alignment_against_plain_smith_waterman():
    for _ in range(30):
        a, b = RNG.integers(0, 4, 12).astype(np.uint64), RNG.integers(0, 4, 25).astype(np.uint64)
        h = np.zeros((13, 26))
        for i in range(1, 13):
            for j in range(1, 26):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), h[i - 1, j] - 0.5, h[i, j - 1] - 0.5)
        assert decontam.align(a, b)[0] == h.max()


def test_line_dedup(spark, docs, none):
    kept = {(r.doc_id, r.text) for r in line_dedup.dedup(docs).collect()}
    assert (11, "l1\nl2\nl3\nl4") in kept and (12, "l0") in kept and (3, None) in kept and (13, "  \n \n  ") in kept
    assert line_dedup.dedup(docs).columns == docs.columns and line_dedup.dedup(none).count() == 0
    data = [(1, "a\nb\nc\nd\na\nb\nc"), (2, "x\nb\nc\nd\ny"), (3, "r\n" * 6), (None, "b\nc\nd")]
    found = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.dedup(spark.createDataFrame(data, "doc_id long, text string").withColumn("n_chars", F.char_length("text").cast("long"))).collect()}
    assert found == {None: ("b\nc\nd", 5), 1: ("a", 1), 2: ("x\ny", 3), 3: ("r\n", 2)}


def test_line_dedup_runs_no_python(docs):
    plan = line_dedup.dedup(docs)._jdf.queryExecution().toString()
    assert not any(k in plan for k in ("Python", "Pandas", "Arrow"))


def test_toxicity_learns_and_scores(spark, none):
    bad = ["vilewort", "snarlfit", "grubbolt"]
    data, labels = [], []
    for k in range(400):
        w = prose(120).split()
        if k % 4 == 0:
            for i in RNG.choice(120, 4, replace=False):
                w[i] = bad[int(RNG.integers(3))]
        data.append((k, " ".join(w)))
        labels.append((k, int(k % 4 == 0)))
    table = spark.createDataFrame(data + [(1000, None), (1001, ""), (None, "x"), (1002, LONG)], "doc_id long, text string").withColumn("score", F.lit(7))
    marks = spark.createDataFrame([*labels, (0, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(table, marks, learn=F.col("doc_id") < 300)
    found = {r.doc_id: r.toxic_score for r in toxicity.score(table, model).collect()}
    assert len(found) == 404 and all(0 <= s <= 1 for s in found.values())
    assert sum((found[k] >= 0.5) == (k % 4 == 0) for k in range(300, 400)) >= 95
    assert found[1001] < 0.5 and found[1002] < 0.5
    assert toxicity.score(none, model).count() == 0
    nothing = toxicity.fit(table, marks.limit(0))
    assert {r.toxic_score for r in toxicity.score(table, nothing).collect()} == {0.0}


def test_packing_finds_neighbours_in_small_tables():
    rng = np.random.default_rng(8)
    blobs = [np.append(rng.permutation(np.arange(1000 * (i % 4) + 1, 1000 * (i % 4) + 40))[:30], 0).astype("<u2").tobytes() for i in range(36)]
    df = np.bincount(np.concatenate([np.unique(np.frombuffer(b, "<u2")) for b in blobs]), minlength=1 << 16)
    index = packing.Index(blobs, df, 36, 31.0, 0.05)
    for d in range(36):
        ranked = packing._best(index.scores(d), 9)
        assert {int(r) % 4 for r in ranked} == {d % 4} and ranked[0] == d


def test_packing_ranks_by_bm25():
    rng = np.random.default_rng(9)
    texts = [rng.integers(1, 60, int(rng.integers(5, 80))) for _ in range(50)]
    blobs = [x.astype("<u2").tobytes() for x in texts]
    n, mean = len(texts), float(np.mean([len(x) for x in texts]))
    df = Counter(int(t) for x in texts for t in set(x.tolist()))
    index = packing.Index(blobs, np.array([df[t] for t in range(1 << 16)]), n, mean, 1.0)
    for d in (0, 7, 49):
        want = [sum(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in set(texts[d].tolist()) if (f := int((x == t).sum()))) for x in texts]
        assert np.allclose(index.scores(d), want)
        assert packing._best(index.scores(d), 10).tolist() == sorted(range(n), key=lambda i: (-round(want[i], 9), i))[:10]


def test_warc_archives_are_cut_by_bytes_and_read_in_one_pass(spark, tmp_path):
    import os
    import time

    pages = spark.range(300).selectExpr("id AS page_id", "'u' AS url", "repeat(sha2(string(id), 256), 50) AS html").repartition(1)
    warc.write(pages, str(tmp_path / "w"), file_bytes=20_000)
    sizes = [os.path.getsize(tmp_path / "w" / f) for f in os.listdir(tmp_path / "w") if f.startswith("part-")]
    assert len(sizes) > 3 and max(sizes) < 30_000
    assert warc.read(spark, str(tmp_path / "w")).count() == 300
    member = warc.record(1, "u", b"x" * 300, "response", None, "d")
    took = []
    for n in (2000, 8000):
        began = time.process_time()
        assert sum(1 for _ in warc.records_of(member * n)) == n
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records_of(member[:-5]))


def test_column_names_may_clash(spark):
    names = ["near_id", "near_mark", "later_id", "later_mark", "later_places", "later_lines", "leak_id", "leak_mark", "id", "mark", "toxic_score"]
    table = spark.createDataFrame([(1, "a\nb\nc\nd " + PASSAGE), (2, "x\na\nb\nc"), (3, None)], "doc_id long, text string")
    for n in names:
        table = table.withColumn(n, F.lit(5))
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").withColumn("mark", F.lit(1))
    for out in (line_dedup.dedup(table), simhash.deduplicate(table), decontam.decontaminate(table, items)):
        assert out.columns == table.columns and {tuple(r[n] for n in names) for r in out.collect()} == {(5,) * len(names)}
    assert [r.doc_id for r in decontam.decontaminate(table, items).orderBy("doc_id").collect()] == [2, 3]
    scored = toxicity.score(table, toxicity.Model(constant=0.25))
    assert scored.columns.count("toxic_score") == 1 and {r.toxic_score for r in scored.collect()} == {0.25}


def test_chat_ranks_branches(spark):
    data = [(1, 0, None, "user", "root", 0.0)] + [(1, 10 * b + k, 10 * b + k - 1 if k > 1 else 0, "assistant", f"{b}-{k}", float(s)) for b, s in ((1, 1), (2, 3), (3, 3), (4, 2)) for k in range(1, 4)]
    found = chat.conversations(spark.createDataFrame(data, "tree_id long, node_id long, parent_id long, role string, text string, score double"), keep=3).collect()
    assert [(r.rank, r.leaf, r.n_turns) for r in sorted(found, key=lambda r: r.rank)] == [(1, 23, 4), (2, 33, 4), (3, 43, 4)]
    assert chat.parse_turns(next(r.text for r in found if r.rank == 2)) == [("user", "root"), ("assistant", "3-1"), ("assistant", "3-2"), ("assistant", "3-3")]


def test_decontamination_against_all_pairs(spark):
    """Every pair that reaches the score around four shared words is found, and none that doesn't reach it anywhere; also over zones, with few words in use."""
    rng = np.random.default_rng(21)
    few = [f"v{k}" for k in range(6)]
    items = [" ".join(rng.choice(few, int(rng.integers(5, 30)))) for _ in range(12)]
    data = []
    for k in range(60):
        w = rng.choice(few, int(rng.integers(3, 60))).tolist()
        if k % 3 == 0:  # a long text with an edited copy far inside, or over the edge of a zone
            item = items[k % 12].split()
            cut = [x for x in item if rng.random() > 0.15]
            w = [f"u{i}" for i in range(int(rng.choice([10, 1020, 3000])))] + w[:8] + cut + [f"t{i}" for i in range(2000)] + item[:4]
        data.append((k, " ".join(w)))
    whole, around = {}, {}
    for d, t in data:
        words = decontam.text_words(t)
        for k, x in enumerate(items):
            sought = decontam.text_words(x)
            n = len(sought)
            seeds = {j - i for i in range(n - 3) for j in range(len(words) - 3) if (sought[i : i + 4] == words[j : j + 4]).all()}
            if seeds:
                whole[d, k] = decontam.align(sought, words)[0] / n
                around[d, k] = max(decontam.align(sought, words[max(0, s - n) : s + 2 * n])[0] for s in seeds) / n
    found = decontam.matches(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    found = {(r.doc_id, r.item_id): r.score for r in found.collect()}
    assert {p for p, s in around.items() if s >= 0.5} <= set(found) <= {p for p, s in whole.items() if s >= 0.5} and len(found) >= 20
    assert all(around[p] - 1e-9 <= s <= whole[p] + 1e-9 for p, s in found.items())


def test_every_query_runs_on_its_tables(spark):
    """The registered queries themselves, with their parameters: columns, one row a document, and the contracts' fixed rules."""
    from annomill.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    scored = {r.doc_id: r for r in QUERIES["op1_toxicity"](spark, sf).collect()}
    assert set(scored) == set(docs) and all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for d, r in scored.items())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(scored[d].predicted, t) for d, t in labels.items() if d in scored and scored[d].held_out and t is not None]
    assert sum(p == t for p, t in judged) >= 0.85 * len(judged)
    chats = {r.conv_id: r for r in QUERIES["op4_chat"](spark, sf).collect()}
    said = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        said[r.conv_id].append((r.turn, r.role, r.text or ""))
    odd = "\\### Assistant: </turn> ok"
    said[-7] = [(0, "user", odd), (1, "assistant", odd)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(chats) == set(said)
    for c, turns in said.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = chats[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{x}\n{t}\n" for _, x, t in turns)), len(loss), sha(loss))
    e = tokens.Encoder(BYTE)
    ids = {d: np.append(np.frombuffer(e.whole(t or ""), "<u2"), 0).astype("<u4") for d, t in docs.items()}
    pieces = defaultdict(list)
    for r in QUERIES["op2_packing"](spark, sf).collect():
        pieces[r.doc_id].append(r)
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.offset + r.length <= 1024
    assert {d: sum(r.length for r in p) for d, p in pieces.items()} == {d: len(x) for d, x in ids.items()}
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    last = {}
    for p, h in pages.items():
        last[h] = max(last.get(h, p), p)
    want = {(p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if last[h] == p else "revisit", None if last[h] == p else last[h]) for p, h in pages.items()}
    assert {tuple(r) for r in QUERIES["op8_warc"](spark, sf).collect()} == want
    order, start, want = sorted(docs), 0, {}
    w = tokens.Encoder(WORD)
    for d in order:
        x = np.append(np.frombuffer(w.whole(docs[d] or ""), "<u2"), 2).astype("<u4")
        want[d] = (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op9_bitplane"](spark, sf).collect()} == want
    prints = {r.doc_id: r.fingerprint for r in QUERIES["op10_simhash"](spark, sf).collect()}
    assert prints == {d: f"{brute_print(t):016x}" for d, t in docs.items()}
    gone = Counter(tuple(words(t)[i : i + 35]) for t in docs.values() for i in range(len(words(t)) - 34))
    for r in QUERIES["op7_substring"](spark, sf).collect():
        x, off = words(docs[r.doc_id]), set()
        for i in range(len(x) - 34):
            if gone[tuple(x[i : i + 35])] > 1:
                off |= set(range(i, i + 35))
        assert (r.n_words, r.n_removed) == (len(x), len(off))
    trees = {r.doc_id: r for r in QUERIES["op3_merkle"](spark, sf).collect()}
    for d, x in zip(order, order[1:] + order[:1], strict=True):
        t, r = docs[d] or "", trees[d]
        e3 = plain_edit(t, docs[x] or "")
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(e3)) and (r.near_next == 1) == (t == (docs[x] or "")) and (r.near_edited == 1) == (t == e3)
    assert QUERIES["op5_decontamination"](spark, sf).count() > 0 and QUERIES["op6_line_dedup"](spark, sf).count() == len(docs)
