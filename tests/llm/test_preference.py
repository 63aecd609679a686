import itertools

from rulespark.llm import preference as p

SCHEMA = "conv_id long, turn long, role string, text string, prompt string"


def brute(a, b):
    k = len(list(itertools.takewhile(lambda x: x[0] == x[1], zip(a, b))))
    text = lambda turns: "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in turns)

    def mask(turns):
        out, at = [], 0
        for r, t in turns:
            start = at + len(r) + 5
            at = start + len(t) + 9
            if r == "assistant":
                out.append((start, at))
        return out

    return k, text(a[:k]), text(a[k:]), mask(a[k:]), text(b[k:]), mask(b[k:])


def test_query_against_brute_force(spark, sf):
    by = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    by = {k: [x[1:] for x in sorted(v)] for k, v in by.items()}
    rows = p.query(spark, sf).collect()
    answered = [k for k in sorted(by) if any(r == "assistant" for r, _ in by[k])]
    nexts = dict(zip(answered, answered[1:] + answered[:1]))
    assert {r.chosen_id: r.rejected_id for r in rows if r.kind == "answer"} == nexts
    last = lambda i: max(k for k, (r, _) in enumerate(by[i]) if r == "assistant")
    for r in rows:
        other = by[r.rejected_id]
        if r.kind == "answer":
            at, answer = last(r.chosen_id), other[last(r.rejected_id)]
            other = [*by[r.chosen_id][:at], answer, *by[r.chosen_id][at + 1 :]]
            assert r.prompt or at == 0
        else:
            assert by[r.chosen_id][0] == other[0]
        k, prompt, chosen, cm, rejected, rm = brute(by[r.chosen_id], other)
        line = lambda m: ",".join(f"{a}-{b}" for a, b in m)
        assert (r.n_common, r.prompt, r.chosen, r.chosen_mask, r.rejected, r.rejected_mask) == (k, prompt, chosen, line(cm), rejected, line(rm))


def test_other_answers(spark):
    rows = [(i, t, r, f"{i}-{t}") for i in (3, 1, 7) for t, r in enumerate(("user", "assistant", "user"))] + [(5, 0, "user", "no answer")]
    convs = p.conversations(spark.createDataFrame([(*r, "") for r in rows], SCHEMA))
    for most in (1, 2, 100):
        got = {r.chosen_id: (r.rejected_id, [t.text for t in r.r]) for r in p.other_answers(convs, most).collect()}
        assert got == {1: (3, ["1-0", "3-1", "1-2"]), 3: (7, ["3-0", "7-1", "3-2"]), 7: (1, ["7-0", "1-1", "7-2"])}
    assert p.other_answers(convs.where("conv_id in (1, 5)")).count() == 0 and p.other_answers(convs.limit(0)).count() == 0


def test_cases(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 2, "user", None), (3, 0, None, ""), (3, None, "user", "é" * 50000), (None, 0, "user", "hi"), (4, 0, "user", "hi"), (4, 0, "user", "hi"), (5, 0, "user", "hi"), (5, 0, "user", "hi")]
    convs = p.conversations(spark.createDataFrame([(*r, "z") for r in rows], SCHEMA))
    pairs = spark.createDataFrame([(1, 2), (1, 9), (4, 5), (3, 3), (8, 9)], "chosen_id long, rejected_id long")
    got = {(r.chosen_id, r.rejected_id): r for r in p.format_pairs(pairs, convs).collect()}
    hi = "<|user|>\nhi\n<|end|>\n"
    assert got[1, 2].prompt == hi and got[1, 2].chosen == "<|assistant|>\nyes\n<|end|>\n" and [tuple(s) for s in got[1, 2].chosen_mask] == [(14, 26)]
    assert got[1, 2].rejected == "<|assistant|>\nno\n<|end|>\n<|user|>\n\n<|end|>\n"
    assert (got[1, 9].n_common, got[1, 9].rejected) == (0, "")
    assert (got[4, 5].n_common, got[4, 5].chosen, got[4, 5].prompt) == (2, "", hi * 2)
    assert got[3, 3].n_common == 2 and got[3, 3].prompt.startswith("<|user|>\né") and got[8, 9].prompt == ""
    assert p.conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_opening_is_split(spark):
    convs = p.conversations(spark.createDataFrame([(i, 0, "user", "same", "") for i in range(2000)] + [(5000, 0, "user", "other", "")], SCHEMA))
    rows = p.same_opening(convs, 100).collect()
    ids = [i for r in rows for i in (r.chosen_id, r.rejected_id) if i is not None]
    assert sorted(ids) == [*range(2000), 5000]
    assert sum(r.rejected_id is None for r in rows) <= 22


def test_partners_are_neighbours_at_any_size(spark):
    """A hot opening over many parts, others within and across parts."""
    opening = {i: "same" if i % 3 else f"t{i % 40}" for i in range(2001)}
    convs = p.conversations(spark.createDataFrame([(i, 0, "user", t, "") for i, t in opening.items()], SCHEMA).repartition(5))
    by = {}
    for i, t in opening.items():
        by.setdefault(t, []).append(i)
    want = {(ids[k], ids[k + 1] if k + 1 < len(ids) else None) for ids in by.values() for k in range(0, len(ids), 2)}
    for most in (100, 512, 1 << 16):
        got = [(r.chosen_id, r.rejected_id) for r in p.same_opening(convs, most).collect()]
        assert len(got) == len(want) and set(got) == want
