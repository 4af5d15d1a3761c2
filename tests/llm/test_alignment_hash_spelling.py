"""Token alignment, piecewise fingerprints and spelling variants against brute force, with the awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm.piecewise_hash import MOST, _common, edited, fingerprint, fingerprints, likeness
from lodestone.llm.spelling_variants import near_words, spelling_variants
from lodestone.llm.token_alignment import align, align_tokens, default_paths, group_marks, tokenizers

SCHEMA = "doc_id long, text string, word string, n int, part long"
AWKWARD = [None, "", " ", "\n\nfoo  bar\tbaz", "one ▁ two", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語 テキスト ① é é ​\x00x", "don't  stop   12345", "a" * 3000, "naïve façade " * 400]


def table(spark, texts, parts=3):
    rows = [(i, t, "w", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "under no number", None, None, None), (None, "under no number", None, None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(parts)


def brute_groups(size_a, size_b):
    """Groups as cut points that both sides share, and all overlapping pairs."""
    spans = lambda sizes: [(int(e - s), int(e)) for s, e in zip(sizes, np.cumsum(sizes))]
    a, b = spans(size_a), spans(size_b)
    links = {(i, j) for i, (s, e) in enumerate(a) for j, (t, f) in enumerate(b) if s < f and t < e}
    cuts = sorted({e for _, e in a} & {e for _, e in b})
    return links, [([i for i, (s, e) in enumerate(a) if lo <= s and e <= hi], [j for j, (s, e) in enumerate(b) if lo <= s and e <= hi]) for lo, hi in zip([0] + cuts, cuts)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=30), st.randoms(use_true_random=False))
def test_align_equals_brute_force(size_a, rng):
    total, size_b = sum(size_a), []
    while sum(size_b) < total:
        size_b.append(rng.randint(1, min(5, total - sum(size_b))))
    a, b, group, group_b = align(np.array(size_a), np.array(size_b))
    links, groups = brute_groups(size_a, size_b)
    assert set(zip(a.tolist(), b.tolist())) == links and len(a) == len(links)
    assert [group[i] for i in range(len(size_a))] == [g for g, (x, _) in enumerate(groups) for _ in x]
    assert group_b.tolist() == [g for g, (_, y) in enumerate(groups) for _ in y]
    want = ";".join(",".join(str(i + 7) for i in x) + "|" + ",".join(str(j + 9) for j in y) for x, y in groups)
    assert b"".join(group_marks(np.arange(len(size_a)) + 7, np.arange(len(size_b)) + 9, group, group_b))[:-1].decode() == want


@pytest.mark.parametrize("heavy,held", [(500_000, 2_000_000), (40, 50), (1, 1)])
def test_token_alignment(spark, heavy, held):
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = default_paths()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    rng = random.Random(3)
    names = [f"{rng.choice(['pre', 'un', 'Re'])}{rng.choice(['value', 'fold', 'stshhe'])}{rng.choice([',', '', 's.'])}" for _ in range(40)]
    rows, docs = table(spark, AWKWARD[:8] + [" ".join(rng.choice(names) for _ in range(rng.randint(1, 60))) for _ in range(20)])
    byte_of = tokenizers((path_a, path_b))
    held_by, per_doc = Counter(), []
    for doc, text, *_ in rows:
        data = (" " + (text or "")).encode()
        ia = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ta, tb = [byte_of.bytes_a[i] for i in ia], [byte_of.bytes_b[i] for i in ib]
        if not text or b"".join(ta) != data or b"".join(tb) != data:
            per_doc.append((doc, [], [], [], []))
            continue
        links, groups = brute_groups(list(map(len, ta)), list(map(len, tb)))
        pairs = [(ia[i], ib[j]) for i, j in links]
        held_by.update(set(pairs))
        per_doc.append((doc, ia, ib, groups, pairs))
    top = Counter()
    for (i, _), n in held_by.items():
        top[i] = max(top[i], n)
    want = []
    for doc, ia, ib, groups, pairs in per_doc:
        text = ";".join(",".join(str(ia[i]) for i in x) + "|" + ",".join(str(ib[j]) for j in y) for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if ia else ""
        want.append((doc, len(ia), len(ib), len(groups), len(pairs), sum(held_by[p] == top[p[0]] for p in pairs), sum(held_by[p] for p in pairs), sha))
    found, pairs = align_tokens(docs, heavy_pairs=heavy, held_pairs=held)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    assert {(r.a_id, r.b_id): (r.n, r.best) for r in pairs.collect()} == {p: (n, n == top[p[0]]) for p, n in held_by.items()}
    assert [w[1] for w in want if w[0] in (0, 1, 4)] == [0, 0, 0]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert align_tokens(none)[0].collect() == fingerprints(none).collect() == spelling_variants(none).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.text("abc", max_size=70), st.text("abc", max_size=70))
def test_common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    assert _common(a, b) == row[-1]


def test_fingerprint_is_local_and_whole():
    rng = random.Random(9)
    make = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(n))
    for n in (20, 200, 3000, 40_000):
        text, other = make(n), make(n)
        own = fingerprint(text)
        block, one, two = own.split(":")
        assert len(one) <= MOST and len(two) <= len(one) and int(block) % 3 == 0
        assert fingerprint(text) == own and fingerprint(text[:-1] + "#") != own and likeness(own, own) == 1
        assert likeness(own, fingerprint(other)) == 0
        half = fingerprint(edited(text, other))
        assert 0.25 < likeness(own, half) < 0.8
        changed = text[: len(text) // 3] + "one small change" + text[len(text) // 3 :]
        assert likeness(own, fingerprint(changed)) > 0.8 and likeness(own, fingerprint(changed)) == likeness(fingerprint(changed), own)
    assert fingerprint(None) == fingerprint("") == "3::" and likeness("3::", own) == 0 and likeness("3::", "3::") == 1
    assert likeness(fingerprint("a" * 100_000), fingerprint("a" * 100_001)) in (0.0, 1.0)


def test_signature_by_definition():
    """Chunks of a text by a loop over its bytes."""
    from lodestone.llm.hashing import Prefix

    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh \n") for _ in range(4000))
    data, hashes = text.encode(), {}
    whole = np.frombuffer(data, np.uint8)
    for i in range(7, len(data) + 1):
        window = whole[i - 7 : i]
        hashes[i] = (int(Prefix(window).windows(7)[0]) >> 32) + 1
    block = 3
    while sum(h % block == 0 for h in hashes.values()) >= MOST:
        block *= 2
    want = [str(block)]
    for size in (block, 2 * block):
        cuts = [0] + [i for i, h in hashes.items() if h % size == 0 and i < len(data)] + [len(data)]
        chunks = [whole[s:e] for s, e in zip(cuts, cuts[1:])]
        want.append("".join("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[int(Prefix(c).spans(np.array([0]), np.array([len(c)]))[0]) >> 58] for c in chunks))
    assert fingerprint(text) == ":".join(want)


@pytest.mark.parametrize("parts,shuffle", [(1, "1"), (3, "7"), (40, "40")])
def test_fingerprints_of_neighbours(spark, parts, shuffle):
    rng = random.Random(4)
    texts = AWKWARD + ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(0, 900))) for _ in range(30)]
    rows, docs = table(spark, texts, parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    try:
        found = [tuple(r) for r in fingerprints(docs).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    line = [(d, t or "") for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    want = []
    for (doc, text), (_, following) in zip(line, line[1:] + line[:1]):
        own, n = fingerprint(text), len(text)
        changed = text[: n - n // 2] + following[: n // 2]
        want.append((doc, n, hashlib.sha256(changed.encode()).hexdigest(), own, fingerprint(changed), likeness(own, fingerprint(changed)), likeness(own, fingerprint(following))))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(found, key=key) == sorted(want, key=key)


def test_lone_document_is_its_own_neighbour(spark):
    (row,) = fingerprints(spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and row.near_next == 1


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, ratio=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(near[w], key=lambda v: (-counts[v], v)) for w in near if near[w]}
    form = {w: v for w, v in best.items() if counts[v] >= ratio * counts[w]}
    out = {}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None)
    return out


@pytest.mark.parametrize("heavy", [50_000, 3, 1])
def test_near_words(spark, heavy):
    rng = random.Random(6)
    words = {"".join(rng.choice("aábz"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 6))) for _ in range(700)}
    counts = {w: rng.choice([1, 5, 5, 26, 700]) for w in words}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(near[w], key=lambda v: (-counts[v], v)) for w in near if near[w]}
    found = near_words(spark.createDataFrame(list(counts.items()), "word string, n long"), heavy).collect()
    assert {r.word: (r.n_near, r.form, r.form_n) for r in found} == {w: (len(near[w]), v, counts[v]) for w, v in best.items()}


def test_spelling_variants(spark):
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 9))) for _ in range(25)]
    texts = []
    for _ in range(260):
        words = []
        for _ in range(40):
            w = stems[min(int(rng.expovariate(0.3)), 24)]
            i = rng.randrange(len(w))
            edits = [w, w, w, w, w.upper() if w.isascii() else w, w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "x" + w[i + 1 :], w[:i] + "xx" + w[i:]]
            words.append(rng.choice(edits))
        texts.append(rng.choice([" ", "-", "1", "ğ"]).join(words))
    texts += ["chainedab " * 6, "chaineda " * 40, "chained " * 220]  # forms lead on
    rows, docs = table(spark, AWKWARD + texts)
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    want = brute_variants(counts)
    found = spelling_variants(docs).collect()
    assert len(found) == len(counts) and {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found} == want
    assert sum(r[0] is not None for r in want.values()) > 20 and any(r[1] != (r[0] or w) for w, r in want.items())
