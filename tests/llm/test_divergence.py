"""op11 against a dictionary version, and its edge cases."""

import re
from collections import Counter

import pytest

from rowcloak.llm.divergence import divergence_audit

SCHEMA = "lang string, source string, text string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {a: a + 32 for a in range(65, 91)}


def brute(rows, min_docs=3, ranks=200):
    docs = [(a or "", b or "", TERM.findall((t or "").translate(UPPER))) for a, b, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df, total = Counter(), Counter()
        for _, _, terms in mine:
            df.update(set(terms))
            total.update(terms)
        kept = [t for t in df if df[t] >= min_docs]
        share = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))  # noqa: B023, E731
        n_lang = sum(total[t] for t in kept)
        own = {}
        for s in {d[1] for d in mine}:
            c = Counter(t for d in mine if d[1] == s for t in d[2])
            n = sum(c[t] for t in kept)
            own[s] = ({t: share(c[t], n) for t in kept}, c)
        f = lambda p, q: (p - q) ** 2 // q
        for s, (p, c) in own.items():
            pairs = [(-sum(f(p[t], own[o][0][t]) for t in kept), o.encode(), o) for o in own if o != s]
            terms = [(-f(p[t], q), t.encode(), t) for t in kept if c[t] and p[t] > (q := share(total[t], n_lang))]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(items)]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def some(n=90):
    words = ["the", "The", "Öl", "öl", "été", "cat", "a-b", "x1y", "日本", "𝒳z", "rare%d"]
    out = []
    for i in range(n):
        text = " ".join(words[(i * 7 + j * j) % len(words)] % (i // 4) if "%d" in words[(i * 7 + j * j) % len(words)] else words[(i * 7 + j * j) % len(words)] for j in range(i % 23))
        out.append((["en", "de", None][i % 7 % 3], f"s{i % 5}" if i % 3 else "hot", text))
    return [*out, ("en", "bare", None), ("en", "bare2", ""), ("fr", "x", "one two"), ("fr", "y", None), ("solo", "z", "a a a")]


@pytest.mark.parametrize("ranks", [200, 2])
def test_like_dictionaries(spark, ranks):
    data = some()
    assert rows(divergence_audit(spark.createDataFrame(data, SCHEMA), ranks=ranks)) == brute(data, ranks=ranks)


def test_equal_values_are_cut_in_utf8_order(spark):
    text = " ".join(chr(97 + i // 26) + chr(97 + i % 26) for i in range(300)) + " é"
    data = [("en", "a", text)] * 4 + [("en", "b", "zz zy")] * 3
    out = divergence_audit(spark.createDataFrame(data, SCHEMA))
    assert rows(out) == brute(data)


def test_empty_table_and_clashing_columns(spark):
    assert rows(divergence_audit(spark.createDataFrame([], SCHEMA))) == []
    data = some(30)
    wide = spark.createDataFrame([(*r, 1, "p") for r in data], SCHEMA + ", value int, part string")
    assert rows(divergence_audit(wide)) == brute(data)
