from collections import defaultdict
from fractions import Fraction

import pytest

from sidelight.llm.mixing import mix_plan, mixed_rows

SCHEMA = "doc_id long, source string, text string, size long"


def filled(sizes, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    """Water-filling step by step, in exact fractions."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total >= most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = Fraction(most * sizes[s])
        left -= sum(out[s] for s in over)
        free -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 9, "b": 400, "c": 30, None: 77}, {"a": 1, "b": 1, "c": 1, "d": 1000}, {"x": 50}, {"a": 0, "b": 10}, {"é": 5, "z": 60, "𝕫": 7, "": 12}])
def test_targets_and_words_taken(spark, sizes):
    rows, i = [], 0
    for s, n in sizes.items():
        for part in [n // 3, n // 3, n - 2 * (n // 3)]:
            rows.append((i, s, " \n".join(["w"] * part), -5))
            i += 1
    got = mix_plan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    want, source = filled(sizes), {r[0]: r[1] for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.target == pytest.approx(float(want[s])) and r.source_size == sizes[s]
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1


def test_reruns_agree_whatever_the_partitions(spark):
    rows = [(i % 40, "ab"[i % 2], "w " * (i % 13), 0) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    a, b = (sorted(map(tuple, mix_plan(x).collect())) for x in (df.repartition(1), df.repartition(7)))
    assert a == b


def test_rows_of_the_mix_hold_the_words_planned(spark):
    rows = [(i, "abc"[i % 3], " ".join(f"w{i}.{k}" for k in range(1 + 7 * i % 50)), 0) for i in range(60)] + [(90, "a", None, 0), (91, "a", "", 0), (None, "b", "x y z", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    plan = defaultdict(int)
    for r in mix_plan(df).collect():
        plan[r.doc_id] += r.taken
    out = mixed_rows(df)
    assert out.columns == df.columns
    words, texts = defaultdict(int), {r[0]: r[2] for r in rows}
    for r in out.collect():
        words[r.doc_id] += len((r.text or "").split())
        assert (texts[r.doc_id] or "").startswith(r.text or "")
    assert {k: v for k, v in plan.items() if v} == {k: v for k, v in words.items() if v}


def test_empty_table_and_null_sources(spark):
    assert mix_plan(spark.createDataFrame([], SCHEMA)).collect() == []
    got = mix_plan(spark.createDataFrame([(1, None, "a b", 0), (2, None, None, 0)], SCHEMA)).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got) == [(1, 2, 2, 3.0, 3), (2, 0, 2, 3.0, 0)]


def plain_taken(rows, seed=17):
    """What each row gives, from the targets and the whole order of a source; equal rows are interchangeable."""
    import hashlib

    size = [len((t or "").split()) for _, _, t, _ in rows]
    per = defaultdict(int)
    for (_, s, _, _), n in zip(rows, size):
        per[s] += n
    target, out = filled(per), []
    for s in per:
        mine = [(hashlib.md5(f"{seed}:{'' if i is None else i}:{n}".encode()).hexdigest(), i is not None, i or 0, n) for (i, src, _, _), n in zip(rows, size) if src == s]
        whole = int(float(target[s]) // per[s]) if per[s] else 0
        need = round(float(target[s])) - whole * per[s]
        for _, known, i, n in sorted(mine):
            extra = max(0, min(n, need))
            need -= extra
            out.append((i if known else None, n, whole * n + extra))
    return sorted(out, key=str)


def test_words_taken_match_the_whole_order(spark):
    rows = [(i, "abcd"[i % 7 % 4], "w " * (i * 37 % 41), 0) for i in range(600)] + [(1000 + i, None, "v " * i, 0) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(((r.doc_id, r.size, r.taken) for r in mix_plan(df).collect()), key=str) == plain_taken(rows)


@pytest.mark.parametrize("rows", [[(4, "a", "x y z", 0)] * 50 + [(5, "b", "w " * 9, 0)], [(None, "a", "w " * (1 + i % 3), 0) for i in range(90)]])
def test_rows_that_are_alike_share_the_end(spark, rows):
    got = mix_plan(spark.createDataFrame(rows, SCHEMA)).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
        assert r.taken <= 2 * r.size
    assert len(got) == len(rows) and all(target[s] - len(rows) < taken[s] <= target[s] + 1 for s in taken)
