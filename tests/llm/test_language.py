from __future__ import annotations

import random

import numpy as np
import pytest

from fathom.llm import language

from .conftest import table

SOUNDS = {
    "aa": "ka lo mi tu ra ne so pi", "bb": "strach quel vint moze grup blent", "cc": "éa ôi ûn ça ïx eù", "dd": "zyx wvu tsr qpo nml kji", "ee": "ийк лом тар вед ос",
    "ff": "abab caca dede fifi gogo", "gg": "the an of ing er on", "hh": "αβγ δελ μνο πρσ", "ii": "sch ung keit ver ein",
}


def texts(languages, n, seed):
    rng = random.Random(seed)
    word = lambda lang: "".join(rng.choices(SOUNDS[lang].split(), k=rng.randint(1, 3)))
    return [(k, " ".join(word(lang) for _ in range(rng.randint(8, 60))), lang, "a") for k, lang in enumerate(rng.choices(languages, k=n))]


@pytest.mark.parametrize("count", [1, 2, 4, 9])
def test_held_out_accuracy(spark, count):
    names = list(SOUNDS)[:count]
    model = language.train(table(spark, texts(names, 400, 1)))
    assert model.languages == names
    hits = [(lang, *model.predict(text)) for _, text, lang, _ in texts(names, 300, 2)]
    assert np.mean([h[0] == h[1] for h in hits]) >= 0.97
    assert all(0 <= h[2] <= 1 for h in hits)


def test_unknown_and_null(spark):
    rows = texts(["aa", "bb"], 80, 3)
    model = language.train(table(spark, [*rows, (None, "ka lo", None, "a"), (900, None, "aa", "a")]))
    odd = [(1, None, "x", ""), (2, "", "x", ""), (3, "12 !! \n…😀", "x", ""), (4, "KA-LO 1 MI_TU ra", None, "")]
    found = {r.doc_id: r for r in language.predict(table(spark, odd).select("doc_id", "text", "source"), model).collect()}
    assert [found[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and found[4].lang_pred == "aa" and found[1].score == 0.0
    assert language.train(table(spark, [])).predict("text")[0] == "und"


def test_codewords_lie_apart():
    for n in (2, 4, 7, 8, 30):
        code = language.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * 99
        assert apart.min() >= (1 if n == 2 else 2 ** (n - 2) if n <= 7 else 5)


def test_marks_and_case_are_no_features():
    a, b = (language.features(language.code_points(t)) for t in ("Ka lo-MI 12", "ka!! LO??? mi"))
    assert (a == b).all()


def test_the_sample_is_bounded(spark):
    rows = texts(["aa", "bb"], 600, 4)
    few = language.train(table(spark, rows), most_rows=20)
    assert np.mean([few.predict(t)[0] == lang for _, t, lang, _ in rows]) > 0.95


def test_features_against_loops():
    mask, mix = 0xFFFFFFFF, [int(x) for x in language._MIX]
    for text in ("Ka lo-MI 12 été", "a", "  ab 😀c", "x" * 3 + "…y z"):
        p = [0]
        for c in text.lower():
            v = ord(c) if c.isalpha() else 0
            if v or p[-1]:
                p.append(v)
        p += [0] if p[-1] else []
        expected: dict[int, int] = {}
        for i in range(len(p)):
            for n in (1, 2, 3, 4):
                gram = p[i : i + n]
                inner = gram[1:-1] if n > 1 else gram
                if len(gram) < n or not all(inner) or not any(gram):
                    continue
                h = gram[0] * mix[0] & mask
                for k, v in enumerate(gram[1:], 1):
                    h = ((h ^ (h >> 15)) * mix[k] + v) & mask
                h = h if n == 1 else (h + n) & mask
                h = (h ^ (h >> 16)) * mix[1] & mask
                expected[h >> 17] = expected.get(h >> 17, 0) + 1
        found = language.features(language.code_points(text))
        assert {int(k): int(found[k]) for k in np.flatnonzero(found)} == expected, text


def test_training_and_decoding_against_loops(spark):
    """Sums, log odds, margins, losses and the nearest codeword, language by language and bit by bit."""
    rows = texts(["aa", "bb", "gg"], 60, 5)
    model = language.train(table(spark, rows))
    sums = {x: sum(language.features(language.code_points(t)).astype(float) for _, t, lang, _ in rows if lang == x) for x in model.languages}
    share = {x: s / s.sum() for x, s in sums.items()}
    bits, flat = model.codes.shape[1], 0.5 / language.DIMENSIONS
    odds, scale, trust = [], [], []
    for k in range(bits):
        side = lambda s: np.mean([share[x] for x, c in zip(model.languages, model.codes, strict=True) if c[k] == s] or [np.full(language.DIMENSIONS, 1 / language.DIMENSIONS)], axis=0)  # noqa: E731,B023
        odds.append(np.log((side(1) + flat) / (side(-1) + flat)))
        means = [float(share[x] @ odds[k]) for x in model.languages]
        scale.append(max(np.mean(np.abs(means)), 1e-6))
        trust.append(max(0.05, min(m * c[k] for m, c in zip(means, model.codes, strict=True)) / scale[k]))
    for _, text, _, _ in texts(["aa", "bb", "gg"], 25, 6):
        counts = language.features(language.code_points(text))
        margins = [float(counts @ odds[k]) / counts.sum() / scale[k] for k in range(bits)]
        loss = [sum(np.log1p(np.exp(-3 * c[k] * margins[k])) * trust[k] for k in range(bits)) / sum(trust) for c in model.codes]
        weight = [np.exp(-8 * min(1, (counts.sum() / 200) ** 0.5) * (v - min(loss))) for v in loss]
        lang, score, ambiguous = model.predict(text)
        assert lang == model.languages[int(np.argmin(loss))] and abs(score - max(weight) / sum(weight)) < 1e-3
        second = sorted(weight)[-2]
        assert ambiguous == (max(weight) < 2 * second) or abs(max(weight) - 2 * second) < 1e-3


def test_ties_repeats_long_texts_and_rows_without_an_id(spark):
    rows = texts(["aa", "bb"], 80, 3)
    same = [(k, t, lang, "a") for k, (_, t, _, _) in enumerate(rows[:40]) for lang in ("yy", "xx")]
    tied = language.train(table(spark, same))
    assert tied.predict(rows[0][1])[0] == "xx" and tied.predict(rows[0][1])[2]
    model = language.train(table(spark, [*rows, *((None, "zyx wvu", "zz", "a") for _ in range(50))]))
    assert model.languages == ["aa", "bb"]
    long = "ka lo mi tu " * 200_000
    found = language.predict(table(spark, [(1, long, "x", ""), (2, rows[0][1], "x", ""), (2, rows[0][1], "x", "")]), model).collect()
    assert found[0].lang_pred == "aa" and len({(r.lang_pred, r.score) for r in found if r.doc_id == 2}) == 1 and len(found) == 3
    assert language.predict(table(spark, []), model).count() == 0
