"""Token alignment, vector codes and SimHash links against brute force, with awkward rows."""

import hashlib
import json
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from labeltab.llm import simhash_dup, token_align, token_pairs, vector_codes
from labeltab.llm.hot_join import join_hot
from labeltab.llm.perfect_hash import PerfectHash
from labeltab.llm.shared import table
from tests.conftest import SF_SMALL


def by_text(rows):
    return Counter(tuple(map(str, r)) for r in rows)


# ---- 11: alignment ----------------------------------------------------------------------------

def brute_alignment(rows, p):
    one, two = Tokenizer.from_file(p.path_a), sentencepiece.SentencePieceProcessor(model_file=p.path_b)
    one.encode_special_tokens = True
    alphabet = token_pairs.byte_alphabet()
    with open(p.path_a, encoding="utf-8") as f:
        special = {t["content"] for t in json.load(f)["added_tokens"]}
    bytes_a = {i: bytes(alphabet[c] for c in t) for t, i in one.get_vocab().items() if t not in special}

    def bytes_b(i):
        x = two.id_to_piece(i)
        return bytes([int(x[3:5], 16)]) if two.is_byte(i) else x.replace("▁", " ").encode()

    found, counts = [], Counter()
    for doc_id, text in rows:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a[i] for i in a) != raw or b"".join(map(bytes_b, b)) != raw:
            found.append((doc_id, [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(bytes_a[i]) for i in a]).tolist(), np.cumsum([len(bytes_b(i)) for i in b]).tolist()
        groups, x, y = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(end, x) + 1, ends_b.index(end, y) + 1
            groups.append((a[x:i], b[y:j]))
            counts[a[i - 1], b[j - 1]] += 1
            x, y = i, j
        found.append((doc_id, a, b, groups))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for doc_id, a, b, groups in found:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[k] == best[k[1]] for k in links),
                    sum(counts[k] for k in links), hashlib.sha256(line.encode()).hexdigest() if a else ""))
    return out, counts


@pytest.mark.parametrize("fan", [2, 256])
def test_alignment_matches_brute_force(spark, make_docs, odd_rows, fan):
    p = token_align.Params(slice_bytes=1 << 17, fan=fan)
    small = [(r.doc_id, r.text) for r in table(spark, SF_SMALL, "documents").limit(60).collect()]
    rows = [r for r in odd_rows if r[0] not in (5, 8)] + [
        (-20, "a▁b"), (-21, "<|endoftext|> <s> </s>"), (-22, "  two  spaces \n\n\t tab "), (-23, "\x00 nul"), (-24, "x" * 3000), *small]
    want, counts = brute_alignment(rows, p)
    docs = make_docs(rows)
    got = token_align.digests(token_align.align_documents(docs, p)).collect()
    assert by_text(got) == by_text(want)
    assert {-20: 0, -21: 1}.items() <= {r.doc_id: int(r.n_a > 0) for r in got}.items()
    pairs = token_align.pair_counts(token_align.count_pairs(docs, p)).collect()
    assert {(r.a, r.b): r.n for r in pairs} == counts


def test_alignment_of_nothing(spark, make_docs):
    empty = make_docs([(1, "x")]).where("doc_id = 2")
    assert token_align.digests(token_align.align_documents(empty)).collect() == []
    only = token_align.digests(token_align.align_documents(make_docs([(1, None), (1, "")]))).collect()
    assert [tuple(r) for r in only] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_libraries_agree_on_settled_characters():
    one = token_pairs.byte_level(token_align.Params().path_a)
    for i in range(0, 0x30000, 7):
        c = chr(i)
        if not 0xD800 <= i < 0xE000 and token_pairs._settled(c):
            text = f" a{c} {c}{c}1 {c}\n{c}  {c}'s"
            assert one.fast.encode_ordinary(text) == one.slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 100, 20_000])
def test_perfect_hash_is_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    h = PerfectHash.unpack(*PerfectHash.build(keys).pack())
    assert sorted(h.numbers(keys)) == list(range(len(keys)))


# ---- 12: vector codes -------------------------------------------------------------------------

def brute_codes(rows, p):
    kept = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    x = np.floor(np.array([v for _, v, _ in kept]) * p.scale).astype(np.int64).reshape(len(kept), p.parts, -1)
    books = x[: p.entries].transpose(1, 0, 2).copy()
    for last in range(p.rounds + 1):
        d = np.stack([((x[:, i, None] - books[i]) ** 2).sum(2) for i in range(p.parts)], 1)
        a = d.argmin(2)
        for i in range(p.parts if last < p.rounds else 0):
            for e in range(books.shape[1]):
                if (a[:, i] == e).any():
                    books[i, e] = x[a[:, i] == e, i].sum(0) // (a[:, i] == e).sum()
    error = d.min(2).sum(1)
    label = Counter()
    for (_, _, lab), e in zip(kept, error):
        label[lab] += int(e)
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return [(i, bytes(c).hex(), int(e), label[lab], sha) for (i, _, lab), c, e in zip(kept, a.astype(np.uint8), error)]


@pytest.mark.parametrize("p", [vector_codes.Params(), vector_codes.Params(entries=5, parts=8, cells=40, memo_cells=7, chunk=50)])
def test_codes_match_brute_force(spark, p):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in table(spark, SF_SMALL, "embeddings").collect()]
    nan = float("nan")
    rows += [(1001, None, 1), (1002, [0.1] * 63 + [None], 1), (1003, [nan] * 64, 1), (1004, [float("inf")] * 64, 2), (1005, [], 2),
             (1006, [0.0] * 64, None), (1006, [0.0] * 64, None), (1007, [-0.001, 300.0] * 32, None), (None, [0.5] * 64, 3)]
    df = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows],
                               "vec_id long, embedding array<double>, label int, code string, error int").repartition(3)
    assert by_text(vector_codes.digests(df, p).collect()) == by_text(brute_codes(rows, p))


def test_codes_of_few_or_no_rows(spark):
    df = spark.createDataFrame([(i, [float(i)] * 16, None) for i in (3, 1, 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id, r.code, r.error) for r in vector_codes.digests(df).collect()) == [
        (1, "00" * 16, 0), (1, "00" * 16, 0), (3, "02" * 16, 0)]
    assert vector_codes.digests(df.where("vec_id = 9")).collect() == []
    with pytest.raises(ValueError):
        vector_codes.digests(spark.createDataFrame([(1, [1.0] * 15, 1)], df.schema)).collect()


def test_candidates_hold_every_nearest_entry():
    rng = np.random.default_rng(3)
    book = rng.integers(-200, 200, (64, 4))
    book[10] = book[3]
    grid = vector_codes.Grid(book, vector_codes.Params())
    x = np.concatenate([rng.integers(-300, 300, (3000, 4)), book, (book[:-1] + book[1:]) // 2])
    d = ((x[:, None] - book) ** 2).sum(2)
    index, best = grid.assign(x)
    assert (index == d.argmin(1)).all() and (best == d.min(1)).all()
    assert np.mean([len(c) for c in grid.lists]) < 48


# ---- 13: SimHash ------------------------------------------------------------------------------

def brute_fingerprint(text, ngram=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i: i + ngram]) for i in range(max(1, len(words) - ngram + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(ids, fps):
    """Smallest id that links of at most two bits reach, by repeated passes over all pairs."""
    f = np.array(fps, np.uint64)
    far = np.iinfo(np.int64).max
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 2
    low = np.array([far if i is None else i for i in ids])
    while True:
        new = np.where(near, low[None, :], far).min(1)
        if (new == low).all():
            return [None if x == far else int(x) for x in low]
        low = new


@pytest.mark.parametrize("bucket", [2048, 3])
def test_simhash_links_match_brute_force(spark, make_docs, odd_rows, bucket):
    rng = np.random.default_rng(1)
    base = [f"w{rng.integers(400)}" for _ in range(300)]
    near = []
    for i in range(150):
        words = list(base)
        words[rng.integers(300)] = f"other{i}"
        near.append((100 + i, " ".join(words)))
    rows = odd_rows + near + [(900, "A b C"), (901, "a B\tc"), (7, "another text under the id")]
    got = simhash_dup.digests(simhash_dup.link_documents(make_docs(rows), bucket=bucket)).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    want = [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, brute_components([i for i, _ in rows], fps))]
    assert by_text(got) == by_text(want)
    assert len({w[2] for w in want if w[0] and 100 <= w[0] < 250}) < 150
    empty = make_docs([(1, "x")]).where("doc_id = 2")
    assert simhash_dup.link_documents(empty).collect() == []


def test_fuzzy_keys_meet_within_two_bits():
    rng = np.random.default_rng(5)
    patterns = simhash_dup.error_patterns()
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    row, key = simhash_dup.fuzzy_keys(fps, patterns)
    assert np.bincount(row).max() <= 18
    for _ in range(30):
        i, j = rng.integers(0, 64, 2)
        other = fps ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j))
        row2, key2 = simhash_dup.fuzzy_keys(other, patterns)
        mine, its = set(zip(row.tolist(), key.tolist())), set(zip(row2.tolist(), key2.tolist()))
        assert {r for r, _ in mine & its} == set(range(300))


@pytest.mark.parametrize("n", [2, 40, 64, 65, 900])
def test_forest_connects_what_links(n):
    rng = np.random.default_rng(n)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(12, rng.integers(0, 5), False))) for _ in range(n)]
    fps = np.unique(np.array(flips) ^ np.uint64(0x123456789ABCDEF))
    pairs = simhash_dup.forest(fps)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    assert all(near[a, b] for a, b in pairs) and len(pairs) < max(2, len(fps))
    label = np.arange(len(fps))
    for _ in range(len(fps)):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert (label == np.array(brute_components(range(len(fps)), fps))).all()


def test_join_hot_equals_left_join(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 7 if i % 2 else 1000 + i) for i in range(6000)], "id long, k long")
    names = spark.createDataFrame([(None, "none"), (1, "one"), (1002, "x"), (5, "five")], "k long, name string")
    want = {(r.id, {None: "none", 1: "one", 1002: "x", 5: "five"}.get(r.k)) for r in rows.collect()}
    got = [(r.id, r.name) for r in join_hot(rows, names, "k").collect()]
    assert len(got) == 6000 and set(got) == want
