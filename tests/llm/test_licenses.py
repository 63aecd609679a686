import math
import re

from rulespark.llm import licenses as L

FILES = [
    (1, "a/b/LICENSE", "Released under the MIT License.\nmore words that are not of it at all, many of them"),
    (2, "a/b/c/x.txt", "nothing"),
    (3, "a/y.txt", "nothing"),
    (4, "a/b/z.txt", "text\nLicensed under the Apache License, Version 2.0.\ntext text text text text text text text text text"),
    (5, "top.txt", "Licensed under CC BY-NC 4.0."),
    (6, "a/b2/w.txt", None),
    (7, None, "x"),
    (8, "q/", ""),
    (9, "a/b/d/license_of_cats.txt", "a license for cats, under the sun"),
    (10, "deep/er/than/all/l.txt", ("word " * 30000) + "license"),
    (3, "a/y.txt", "nothing"),
]


def brute(files, least=L.LEAST):
    """Own licence of each text."""
    n = len(files)
    df = {w: sum(w in L.terms(t or "") for _, _, t in files) for w in L.VOCABULARY}
    idf = lambda w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1
    out = []
    for i, _, t in files:
        best = (0, None)
        for line in (t or "").split("\n"):
            ws = L.terms(line)
            v = {w: ws.count(w) * idf(w) for w in set(ws)}
            for name, s in L.TEMPLATES.items():
                u = {w: L.terms(s).count(w) * idf(w) for w in set(L.terms(s))}
                dot = sum(v[w] * u.get(w, 0) for w in v)
                if dot:
                    c = round(dot / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in u.values())), 6)
                    if c >= least:
                        best = min(best, (-c, name))
        out.append((i, best[1], -best[0] if best[1] else None))
    return out


def test_inheritance_and_cases(spark):
    df = spark.createDataFrame([(*f, "clash") for f in FILES], "doc_id long, path string, text string, license string")
    rows = {r.doc_id: r for r in L.scan(df).collect()}
    assert L.scan(df).count() == len(FILES)
    assert (rows[1].license, rows[1].inherited_from) == ("MIT", None)
    assert (rows[2].license, rows[2].inherited_from) == ("MIT", "a/b")
    assert (rows[3].license, rows[3].inherited_from) == ("CC-BY-NC-4.0", "")
    assert rows[4].own_license == "Apache-2.0" and rows[4].license == "Apache-2.0"
    assert (rows[6].license, rows[6].inherited_from) == ("CC-BY-NC-4.0", "")
    assert rows[7].license is None and rows[8].license == "CC-BY-NC-4.0"
    assert rows[9].own_license is None and rows[9].inherited_from == "a/b" and rows[10].own_license is None
    assert L.scan(df.limit(0)).count() == 0


def test_prefilter_loses_nothing(spark):
    docs = [(r.doc_id, None, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).collect()]
    docs += [(10000 + i, None, t) for i, (_, _, t) in enumerate(FILES)] + [(20000, None, "Public License"), (20001, None, "the work is licensed under version")]
    got = {(r.doc_id, r.own_license, r.own_cosine) for r in L.scan(spark.createDataFrame(docs, "doc_id long, path string, text string")).collect()}
    assert got == set(brute(docs))


def test_required_words():
    assert all(re.fullmatch("[a-z0-9]+", w) for w in L.required(L.weights(dict.fromkeys(L.VOCABULARY, 1.0)), 0.7))
