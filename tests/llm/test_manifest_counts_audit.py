"""Manifest, token counts and filter audit against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import public_tokenizers
import pytest

from tidewatch.llm import audit, merkle, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, mask int, first long"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdeT", k=rng.randint(1, 7)))
    out = [(i, " ".join(word() for _ in range(rng.randint(0, 90))), "en", "big" if i % 3 else "é", i, 1, "k", 2, 3) for i in range(620)]
    copies = ["", "Same text " * 30, "x" * 70 + "a", "x" * 70 + "b", "y" * 1100 + "a", "y" * 1100 + "b", "A#", "the $5 " * 60]
    out += [(1000 + i, copies[i % len(copies)], None, [None, "", "a", "z"][i % 4], None, 1, "k", 2, 3) for i in range(40)]
    out += [(2000, None, "en", "lone", 0, None, None, None, None), (None, "Same text " * 30, None, "a", None, None, None, None, None)]
    out += [out[5], out[5], (None,) * 9, (3000, "long " * 40_000, "en", "a", 1, 1, "", 0, 0)]
    return out


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(r[0], 1 if (r[0] or 0) % 2 else 0, 1 if (r[0] or 0) % 7 == 0 else 0) for r in ROWS if r[0] is None or r[0] % 3 == 0]
    return spark.createDataFrame([*rows, (3000, 1, None), (3000, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(level):
    """Levels from the given nodes to one."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def _way(levels, i):
    """(digests before, digests behind) on each level."""
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        yield run[: i % 16], run[i % 16 + 1 :]
        i //= 16


def _manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
    leaf = lambda r, text: _h(*map(field, (r[0], r[3], r[2], r[4], text)))
    by = collections.defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        plain = leaf(r, r[1])
        by[r[3]].append((r[0], plain, leaf(r, lower(r[1])) if hit else plain))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _tree([x[1] for x in sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for s in names}
    top = _tree([trees[s][-1][0] for s in names])
    for j, s in enumerate(names):
        for i, (doc_id, plain, node) in enumerate(sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            way = [*_way(trees[s], i), *_way(top, j)]
            for left, right in way:
                node = _h(*left, node, *right)
            proof = _h(*(x for left, right in way for x in left + right))
            yield (doc_id, plain, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0])


def _key(row):
    return tuple((x is not None, x) for x in row)


def test_manifest(docs, spark):
    got = merkle.manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = sorted(map(tuple, got.collect()), key=_key)
    assert rows == sorted(_manifest(ROWS), key=_key)
    assert 0 < sum(not r[-1] for r in rows) < len(rows)
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    # One row is leaf, subroot and root; 257 leaves are two blocks.
    for some in (ROWS[:1], [(i, "t", None, "s", i, *ROWS[0][5:]) for i in range(257)]):
        alone = merkle.manifest(spark.createDataFrame(some, SCHEMA)).collect()
        assert sorted(map(tuple, alone), key=_key) == sorted(_manifest(some), key=_key)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 240, 255, 256])
def test_block_levels(n):
    import numpy as np

    leaves = [_h(str(i)) for i in range(n)]
    levels = merkle.climb(np.frombuffer("".join(leaves).encode(), np.uint8).reshape(-1, 64), n)
    assert [[x.tobytes().decode() for x in level] for level in levels] == _tree(leaves)
    for i, way in enumerate(merkle._ways(levels, n)):
        assert merkle.fold(leaves[i].encode(), way).decode() == _tree(leaves)[-1][0]
        assert [s.decode() for _, s in way] == ["".join(a + b) for a, b in _way(_tree(leaves), i)]


def test_merges_never_resurrect_stale_pairs():
    """Random texts over few letters, where pairs change under the heap."""
    import sentencepiece

    model, counter = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_counts.Counter(PIECES)
    rng = random.Random(3)
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for alphabet in ("ab", "ein", "the ", "▁a ", "\n\t x", "日é🎉a", "-=_", "<s>/unk") for _ in range(150)]
    texts += ["aaaa" * 3000, "▁" * 50, " " * 501, "\x00", "<s></s><unk><0x41>", "ﬁ Ａ", "é", "a" * 7 + " " * 9 + "\r\n"]
    assert [counter.text(t) for t in texts] == [len(x) for x in model.encode(texts)]
    assert [counter.text(t) for t in texts] == [len(x) for x in model.encode(texts)]


def test_token_counts(docs, spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted((tuple(r) for r in token_counts.count_tokens(docs, PIECES).collect()), key=_key)
    want = [(r[0], len((r[1] or "").encode()), n := len(model.encode(r[1] or "")), n > 4096) for r in ROWS]
    assert got == sorted(want, key=_key) and any(r[3] for r in got)
    assert token_counts.count_tokens(spark.createDataFrame([], SCHEMA), PIECES).count() == 0


def _audit(rows, said):
    masks, good, toxic = [], {r[0] for r in said if r[1] == 1}, {r[0] for r in said if r[2] == 1}
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(r[0], least.get(r[1] or "", r[0]))
    for r in rows:
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t))]
        fails.append(r[0] is not None and r[0] > least[t])
        known = r[0] is not None
        masks.append((r[3] or "", dict(zip("ABCDE", fails, strict=True)), known and r[0] in good, known and r[0] in toxic))
    for part in {m[0] for m in masks}:
        mine, out, shapley = [m for m in masks if m[0] == part], [], collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [m for m in left if m[1][f]]
                left = [m for m in left if not m[1][f]]
                shapley[f] += len(gone)
                before = [m for m in mine if m[1][f] and any(m[1][x] for x in order[: step - 1])]
                only = [m for m in mine if m[1][f] and sum(m[1].values()) == 1]
                out.append((part, order, step, len(left), len(gone), len(before), len(only), sum(m[2] for m in gone), sum(m[3] for m in gone)))
        yield from (row + (shapley[row[1][row[2] - 1]],) for row in out)


@pytest.mark.parametrize(("bits", "most"), [(64, 1_000_000), (1, 3)])
def test_audit(docs, labels, bits, most):
    """One bit a block makes different texts of a class; three classes at most sent
    make the joins of heavy and of other classes."""
    got = audit.interactions(docs, labels, bits, most)
    want = sorted(_audit(ROWS, labels.collect()))
    assert sorted(map(tuple, got.collect())) == want and len(want) == 600 * len({r[3] or "" for r in ROWS})


def test_audit_of_nothing(labels, docs, spark):
    assert audit.interactions(spark.createDataFrame([], SCHEMA), labels).count() == 0
    none = audit.interactions(docs, labels.limit(0))
    assert none.where("good_lost > 0 or toxic_lost > 0").count() == 0 and none.count() > 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_met_with_and_without_sending(spark, how):
    rows = spark.createDataFrame([(i, i % 7) for i in range(50)], "id long, k long")
    classes = spark.createDataFrame([(k, 5 - k) for k in range(5)], "k long, n long")
    want = sorted(map(tuple, audit.met(rows, classes, ["k"], "n", 1, how).collect()), key=_key)
    got = sorted(map(tuple, audit.met(rows, classes, ["k"], "n", 20_000, how, 2).collect()), key=_key)
    assert got == want
