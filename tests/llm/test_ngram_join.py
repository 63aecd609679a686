import random
import re

from rulespark.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, n, percent):
    sets = {}
    for k, (i, t) in enumerate(docs):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for k, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(k)
    for k, s in sets.items():
        for o in {o for g in s for o in where[g] if o < k}:
            c = len(s & sets[o])
            if 100 * c >= percent * len(s | sets[o]):
                up[find(k)] = find(o)
    low = {}
    for k, (i, _) in enumerate(docs):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, len(sets[k]), low[find(k)]) for k, (i, _) in enumerate(docs))


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_sample(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(ngram_join.query(spark, sf)) == brute(docs, 3, 90)


def near_copies(seed, words, copies, edits, families):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    out = []
    for _ in range(families):
        base = [r.choice(vocab) for _ in range(words)]
        for _ in range(copies):
            t = list(base)
            for _ in range(r.randrange(edits + 1)):
                t[r.randrange(len(t))] = r.choice(vocab)
            out.append(" ".join(t))
    r.shuffle(out)
    return list(enumerate(out))


def test_large_family_of_near_copies(spark):
    docs = near_copies(1, 120, 150, 4, 2) + [(k + 1000, "w1 w2 " * k) for k in range(1, 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(ngram_join.join(df, 3, 90)) == brute(docs, 3, 90)


def test_chains_and_lower_threshold(spark):
    docs = near_copies(2, 40, 12, 3, 8) + [(900 + k, " ".join(f"c{j}" for j in range(k, k + 60))) for k in range(0, 60, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(ngram_join.join(df)) == brute(docs, 5, 80)


def test_cases(spark):
    docs = [(5, "A b C d"), (3, "a B c D"), (1, None), (2, ""), (4, " \t\n"), (6, "one two"), (7, "ONE two"), (8, "one"), (9, "a\x0bb\x0cc d"), (10, "x " * 30000 + "y z"), (11, "x " * 30000 + "y z"), (3, "a B c D")]
    df = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, n int, s1 string")
    assert got(ngram_join.join(df, 3, 90)) == brute(docs, 3, 90)
    none = ngram_join.join(spark.createDataFrame([(None, "a b c d"), (1, "a b c d")], "doc_id long, text string"), 3, 90).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in none} == {(None, 2, None), (1, 2, 1)}
    assert ngram_join.join(df.limit(0), 3, 90).count() == 0


def test_long_lists_are_dealt_by_size(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_LEAST", 2)
    monkeypatch.setattr(ngram_join, "LONG_LIST", 3)
    docs = near_copies(5, 60, 30, 4, 3) + [(2000 + k, " ".join(f"s{j}" for j in range(40 + k))) for k in range(40)]
    for n, percent in ((3, 90), (5, 80), (3, 100)):
        assert got(ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string"), n, percent)) == brute(docs, n, percent)
