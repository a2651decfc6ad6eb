import hashlib
import random

from sidelight.llm.line_dedup import drop_repeated_lines

SPACES = " \t\n\x0b\f\r"


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(SPACES))


def brute_force(rows, min_docs=2, min_chars=10):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    order = lambda i: (i is None, i or 0)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or min(holders[key(x)], key=order) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(df, **options):
    rows = drop_repeated_lines(df, **options).select("doc_id", "text", "n_lines", "n_dropped").collect()
    return sorted(((r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in rows), key=str)


def test_matches_brute_force(spark, docs):
    rng = random.Random(1)
    pool = ["short", "a line of text", "A LINE of text ", "\tÉtude longue à lire\r", "étude longue à lire", "ten chars!", "nine char", "", "x" * 5000]
    rows = [(rng.choice([None, *range(25)]), rng.choice([None, "", "\n", "\n".join(rng.choices(pool, k=rng.randrange(1, 30)))])) for _ in range(60)]
    assert run(docs([t for _, t in rows], [i for i, _ in rows])) == brute_force(rows)


def test_threshold_is_a_parameter(spark, docs):
    rows = list(enumerate(["a line of text\nb", "a line of text", "a line of text\nanother long line", "another long line"]))
    for n in (2, 3, 4):
        assert run(docs([t for _, t in rows]), min_docs=n) == brute_force(rows, n)


def test_all_columns_pass_and_empty_table(spark, docs):
    df = docs(["one line that is long", "one line that is long"])
    out = drop_repeated_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    assert drop_repeated_lines(docs([])).collect() == []


def test_result_named_columns_are_replaced(spark, docs):
    df = docs(["one line that is long", "one line that is long"]).withColumnRenamed("kept", "n_lines")
    assert sorted((r.doc_id, r.n_lines, r.text) for r in drop_repeated_lines(df).collect()) == [(0, 1, "one line that is long"), (1, 1, "")]


def test_query_on_driver_tables(spark):
    from sidelight.llm.line_dedup import op10_line_dedup

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in brute_force(rows)}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in op10_line_dedup(spark, sf).collect()} == want
