import numpy as np
import pytest

from loomgrain.llm import langid


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def models(docs):
    return langid.train(docs.filter(langid.fold("doc_id", 5) != 0), sample=100)


def test_held_out_accuracy(docs, models):
    out = langid.identify(docs.filter(langid.fold("doc_id", 5) == 0), models).collect()
    right = np.mean([r.lang_pred == r.lang for r in out])
    assert right > 0.97, right
    assert np.mean([r.rejected for r in out]) < 0.02
    assert all(0 <= r.score <= 1 for r in out)


def kneser_ney(counted, order, alphabet):
    """P(next | before) by the textbook definition over tuples of characters, 0 for a word's boundary."""
    raw = [{} for _ in range(order + 1)]
    for word, n in counted:
        codes = [0] * (order - 1) + [ord(c) for c in word] + [0]
        for at in range(order - 1, len(codes)):
            for k in range(1, order + 1):
                g = tuple(codes[at - k + 1 : at + 1])
                raw[k][g, at - k + 1 < order - 1] = raw[k].get((g, at - k + 1 < order - 1), 0) + n
    counts = [{} for _ in range(order + 1)]
    for k in range(1, order + 1):
        longer = {g for g, _ in raw[k + 1]} if k < order else set()
        for (g, opening), n in raw[k].items():
            counts[k][g] = n if k == order or opening else sum(x[1:] == g for x in longer)
    discount = []
    for k in range(order + 1):
        once, twice = (sum(n == x for n in counts[k].values()) for x in (1, 2))
        discount.append(min(0.95, max(0.1, once / (once + 2 * twice) if once else 0.5)))

    def p(before, nxt, k=order):
        if k == 0:
            return 1 / alphabet
        context = tuple(before[len(before) - k + 1 :])
        own = [n for g, n in counts[k].items() if g[:-1] == context]
        if not own:
            return p(before, nxt, k - 1)
        n = counts[k].get((*context, nxt), 0)
        return max(n - discount[k], 0) / sum(own) + discount[k] * len(own) / sum(own) * p(before, nxt, k - 1)

    return p


def test_same_as_the_textbook():
    words = [("a", "abab", 3), ("a", "ba", 1), ("b", "cab", 2), ("b", "c", 5), ("a", "bab", 1), ("b", "abc", 1), ("b", "é", 1), ("c", "a", 1)]
    m = langid.fit(words)
    alphabet = len({c for _, w, _ in words for c in w}) + 2  # the boundary, and one for all unknown characters
    for i, name in enumerate(m.languages):
        p = kneser_ney([(w, n) for x, w, n in words if x == name], langid.ORDER, alphabet)
        for before in ("", "a", "ab", "aba", "zz", "cab", "babab"):
            padded = [0] * (langid.ORDER - 1) + [ord(c) for c in before]
            total = 0
            for nxt in ("a", "b", "c", "é", "", "q"):
                d = np.array([ord(c) for c in before + nxt], np.uint32)
                codes, at, _, _ = langid._padded(d, np.array([0]), np.array([len(d)]))
                got, want = np.exp2(predicted(m, codes, at[len(before)]))[i], p(padded, ord(nxt) if nxt else 0)
                assert abs(got - want) < 1e-5, (name, before, nxt, got, want)
                total += want
            assert abs(total - 1) < 1e-9
    data, begin, end, place, text = langid.word_table(["abab cab c"])
    whole = m.score_words(data, begin, end)[place].sum(0)
    for i, name in enumerate(m.languages):
        p = kneser_ney([(w, n) for x, w, n in words if x == name], langid.ORDER, alphabet)
        each = [np.log2(p([0] * 4 + [ord(c) for c in w[:j]], ord(w[j]) if j < len(w) else 0)) for w in ("abab", "cab", "c") for j in range(len(w) + 1)]
        assert abs(sum(each) - whole[i]) < 1e-3


def test_a_hot_text_pushes_nothing_out(spark):
    """Copies of one text count once, wherever they stand; every language stays in the model."""
    base = {"en": "the house and the people of this town", "de": "das haus und die leute der stadt", "fr": "la maison et les gens de la ville", "es": "la casa y la gente del pueblo"}
    rows = [(f"{t} {i}{'abcdefgh'[i % 8] * 3}", x) for x, t in base.items() for i in range(300)]
    hot = [("the hot text of the english house", "en")] * 3000
    for order in (rows + hot, hot + rows):
        models = langid.train(spark.createDataFrame(order, "text string, lang string"), sample=40)
        assert models.languages == ["de", "en", "es", "fr"]
        out = langid.identify(spark.createDataFrame([(t,) for t in base.values()], "text string"), models).collect()
        assert [r.lang_pred for r in out] == list(base)
    one = langid.train(spark.createDataFrame(rows[:1] + rows[300:301], "text string, lang string"))
    assert one.languages == ["de", "en"]  # one text is enough to be learned


def test_ties_go_to_the_first_language(spark):
    models = langid.fit([(x, "same", 3) for x in ("b", "a", "c")])
    models.limit = np.full(3, np.inf)
    assert langid.identify(spark.createDataFrame([("same words",)], "text string"), models).first().lang_pred == "a"


def predicted(m, codes, place):
    out = np.zeros(len(m.languages))
    at = np.array([place])
    for k in range(langid.ORDER, 0, -1):
        found, row = langid._lookup(m.grams[k - 1], langid._grams(codes, at, k))
        if found[0]:
            return out + m.logp[k - 1][row[0]]
        seen, row = langid._lookup(m.contexts[k - 1], langid._grams(codes, at - 1, k - 1))
        if seen[0]:
            out = out + m.weight[k - 1][row[0]]
    return out + m.floor


def test_defined_cases(spark, models):
    rows = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "123 --- 中", "x"), (4, "12 %%", None), (5, "the and of that with " * 30_000, "x"), (5, "the and of that with " * 30_000, "x")]
        + [(6, "zxqj vvkx qqzw jxkq wqzx kkvj zqxw " * 20, "x")],
        "doc_id long, text string, score string",
    )
    out = langid.identify(rows, models).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 7
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (1, 2, 4))
    assert got[3].lang_pred != "und" and got[5].lang_pred == "en" and not got[5].rejected and got[6].rejected
    assert langid.identify(rows.limit(0), models).collect() == []
    empty = langid.train(rows.limit(0).withColumnRenamed("score", "lang"))
    assert empty is None and {r.lang_pred for r in langid.identify(rows, None).collect()} == {"und"}
