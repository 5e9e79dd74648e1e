"""Token counts, spelling variants and whitened embeddings against plain versions of their rules."""

import random
import re
import zlib
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest

pytest.importorskip("patentkin.llm")

from patentkin.llm import spelling, token_counts, whitening  # noqa: E402
from patentkin.llm.queries import QUERIES  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, n long, word string, form string, `a.b` int, n_tokens int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, "w", "f", 1, 2) for i, t in rows], SCHEMA)


# --- token counts ---------------------------------------------------------------------------

MIXED = "abcdefgh   \n\téüß中文😀▁\x00<s></s>AE.,1234"


def odd_text(chance, kind):
    if kind:
        return "".join(chance.choice(MIXED) for _ in range(chance.randrange(200)))
    return " ".join("".join(chance.choice("abcdeé ") for _ in range(chance.randrange(9))) for _ in range(60))


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_split_texts_have_the_tokens_of_whole_ones(name):
    chance, count = random.Random(1), token_counts.counter(name)
    assert count.splits
    cut = 0
    for k in range(600):
        text = odd_text(chance, k % 2)
        if not k % 7:
            text = text.replace("a", "<|endoftext|>")
        parts = list(token_counts.split_parts(text, count, chance.choice([3, 7, 20])))
        cut += len(parts) > 1
        assert sum(count.lengths([p])[0] - extra for p, extra in parts) == count.lengths([text])[0]
    assert cut > 200


def test_token_counts(spark, monkeypatch):
    from sentencepiece import SentencePieceProcessor

    import public_tokenizers

    chance = random.Random(2)
    rows = [(k, odd_text(chance, k % 2)) for k in range(40)]
    rows += [(50, None), (51, ""), (52, "  "), (53, "a" * 60_000), (54, "word " * 20_000), (55, "<s> </s> <unk>")]
    rows += [(56, "same"), (56, "same"), (56, "other text"), (None, "no id"), (None, None), (57, "中" * 20_000)]
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = sorted(
        (str(i), len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in rows
    )
    docs = documents(spark, rows)
    found = token_counts.count_tokens(docs)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == expected
    assert token_counts.count_tokens(docs.limit(0)).count() == 0
    named = token_counts.count_tokens(docs.selectExpr("'x' || doc_id AS doc_id", "text"), limit=3)
    assert named.where("doc_id = 'x56' and over_limit").count() == 0 and named.count() == len(rows)


# --- spelling variants ----------------------------------------------------------------------


def edits(a, b):
    """Whether one inserted, deleted or replaced letter turns a into b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_groups(rows, one_in, least=5, ratio=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= least}
    near = {w: [v for v in words if edits(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= ratio * words[w]:
            form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w))))
    return sorted(out, key=str)


def variants(chance, word, n):
    """`word` with n random edits one after the other, each of which is kept."""
    letters = "abcdeé"
    out = [word]
    for _ in range(n):
        base = chance.choice(out[-4:])
        k = chance.randrange(len(base))
        out.append(
            chance.choice([base[:k] + base[k + 1 :], base[:k] + chance.choice(letters) + base[k:], base[:k] + "z" + base[k + 1 :]])
        )
    return out


@pytest.mark.parametrize("one_in, hot_words", [(199, 64), (3, 2)])
def test_spelling_groups(spark, monkeypatch, one_in, hot_words):
    chance = random.Random(one_in)
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (hot_words,))
    texts = []
    for word in ("abcabcabc", "éabcdé", "spelling", "aaaaaaa", "ÀÉüßæø"):
        own = variants(chance, word, 25)
        for k, v in enumerate(own):
            texts += [v] * chance.choice([5, 6, 30, 160, 800])
            if k < 3:
                texts += [v.upper()] * 5
    chance.shuffle(texts)
    rows = [(k, " ".join(texts[k::40]) + ", 12 x") for k in range(40)]
    rows += [(90, None), (91, ""), (92, "a" * 30_000), (None, "spelling " * 7), (None, "spellinge " * 40)]
    rows += [(93, "repeated repeated")] * 4 + [(94, "chainab " * 5), (95, "chainabc " * 25), (96, "chainabcd " * 125)]
    found = spelling.spelling_groups(documents(spark, rows), one_in=one_in)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == plain_groups(rows, one_in)
    assert any(f is not None and f != r for _, f, r, *_ in got)
    for nothing in ([], [(1, None)], [(1, "few words here")]):
        assert spelling.spelling_groups(documents(spark, nothing)).collect() == []


def test_signatures_meet():
    chance = random.Random(3)
    for _ in range(300):
        word = "".join(chance.choice("abcé") for _ in range(chance.randrange(1, 14)))
        other = variants(chance, word, 1)[1]
        one, two = spelling.letter_signatures([word, other or "a"])
        if other and edits(word, other):
            assert set(one.tolist()) & set(two.tolist())


# --- whitened embeddings --------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, component int, deviation int, n int, `a.b` int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], VECTORS)


def plain_whitening(rows, components, ones=False):
    kept = [
        (i, [int(np.floor(1024 * np.float64(np.float32(c)))) + 100_000 for c in v])
        for i, v in rows
        if v and len(v) == 5 and all(c is not None and np.isfinite(c) for c in v)
    ]
    fit = [list(v) for v in {tuple(v) for _, v in kept}] if ones else [v for _, v in kept]
    x = np.array(fit, dtype=np.int64)
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    out = []
    for i, v in kept:
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(v, sums, strict=True))
        out.append((i, deviation, (np.array(v) - sums / n) @ axes / np.sqrt(values)))
    return n, out, values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("weights", ["counts", "ones"])
def test_whitening(spark, weights):
    chance = random.Random(4)
    base = [[chance.gauss(0, 1 + d) for d in range(5)] for _ in range(60)]
    rows = [(k, v) for k, v in enumerate(base)] + [(100 + k, base[0]) for k in range(50)] + [(5, base[1]), (None, base[2])]
    odd = [(200, None), (201, []), (202, [1.0] * 4), (203, [1.0, None, 0.0, 0.0, 0.0]), (204, [float("nan")] * 5)]
    odd += [(205, [float("inf")] + [0.0] * 4), (206, [3e38, 0.0, 0.0, 0.0, 0.0])]
    n, expected, share = plain_whitening(rows, 3, weights == "ones")
    found = whitening.whiten(vectors(spark, rows + odd), components=3, weights=weights)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = found.collect()
    assert len(got) == 3 * len(rows) and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-10
    signs = {}
    by = {}
    for i, deviation, coordinates in expected:
        by.setdefault((i, deviation), coordinates)
    for r in sorted(got, key=lambda r: -abs(r["whitened"])):
        want = by[r["vec_id"], int(r["deviation"])][r["component"] - 1]
        sign = signs.setdefault(r["component"], 1 if r["whitened"] * want > 0 else -1)
        assert abs(r["whitened"] - sign * want) < 1e-9
        assert abs(r["explained"] - share[r["component"] - 1]) < 1e-9
    assert Counter((r["vec_id"], r["component"]) for r in got)[(5, 1)] == 2


def test_whitening_of_little(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r["component"], r["whitened"], r["explained"], int(r["deviation"])) for r in one] == [(1, None, 0, 0), (2, None, 0, 0)]
    line = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0])])).collect()
    assert {r["component"] for r in line if r["whitened"] is not None} == {1}
    assert all(abs(abs(r["whitened"]) - 1) < 1e-12 for r in line if r["component"] == 1)


def test_large_numbers_stay_exact(spark):
    rows = [(k, [float(2**30 * k + d) for d in range(3)]) for k in range(1, 5)]
    x = [[int(np.float32(c)) * 1024 + 100_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = {k + 1: sum((4 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for k, v in enumerate(x)}
    found = whitening.whiten(vectors(spark, rows)).collect()
    assert {r["vec_id"]: int(r["deviation"]) for r in found} == want
    assert max(want.values()) > 2**63
    big = np.array([[2**50, 0, 1], [2**30, 1, 1]], dtype=np.int64)
    assert whitening._deviations(big, 2**20, [0, 0, 0]) == [None, Decimal(2**100 + 2 * 2**40)]


def test_queries_read_whole_tables(spark):
    folder = "/root/testdata/sf0.001"
    assert QUERIES["op11_token_counts"](spark, folder).count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    found = QUERIES["op13_embedding_whitening"](spark, folder)
    assert dict(found.dtypes)["deviation"] == "bigint" and found.where("deviation is null").count() == 0


def test_long_texts_are_thinned_over_their_whole_length(spark):
    from patentkin.llm.labelled import STRETCHES, spread
    from pyspark.sql import functions as F

    text = "".join(chr(0x4E00 + k) for k in range(5_000))
    rows = [(text, n) for n in (0, 1, 15, 16, 17, 100, 4_999, 5_000, 9_000)] + [("", 5), (None, 5)]
    found = spark.createDataFrame(rows, "text string, n int").select("text", "n", spread(F.col("text"), F.col("n")).alias("s")).collect()
    for r in found:
        assert (r["s"] is None) if r["text"] is None else len(r["s"]) == min(len(r["text"]), r["n"])
    held = next(r["s"] for r in found if r["n"] == 100)
    places = [ord(c) - 0x4E00 for c in held]
    assert places[0] == 0 and places[-1] == 4_999 and places == sorted(places)
    assert all(any(low <= p < low + 2 * 5_000 // STRETCHES for p in places) for low in range(0, 4_400, 200))
