import random
import re

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sidelight.llm import chunk_dedup as cd


def plain_chunks(text):
    """The rule stated word by word: (number of the first word, first byte, end byte)."""
    data, words, at = text.encode(), [], 0
    space = b" \t\n\x0b\x0c\r"
    while at < len(data):
        if data[at] in space:
            at += 1
            continue
        end = at
        while end < len(data) and data[end] not in space:
            end += 1
        words.append((at, end))
        at = end
    hashes = []
    for _, end in words[cd.CHUNK_WORDS - 1 :]:
        window = data[max(0, end - 32) : end]
        hashes.append(sum(int(cd._GEAR[b]) << (len(window) - 1 - k) for k, b in enumerate(window)) % (1 << 32))
    width, out = min(cd.WITHIN, len(hashes)), set()
    for k in range(len(hashes) - width + 1 if hashes else 0):
        some = hashes[k : k + width]
        out.add(k + max(i for i, h in enumerate(some) if h == max(some)))
    return [(w, words[w][0], words[w + cd.CHUNK_WORDS - 1][1]) for w in sorted(out)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="abcé ", min_size=1, max_size=6), max_size=120))
def test_chunks_follow_the_rule(words):
    text = "\n".join(words)
    assert list(zip(*(x.tolist() for x in cd.word_chunks(text.encode())))) == plain_chunks(text)


def thinned(chunks):
    """Of chunks equal to both neighbours, those without which there would be a gap."""
    out = []
    for k, c in enumerate(chunks):
        inside = 0 < k < len(chunks) - 1 and chunks[k - 1][3] == c[3] == chunks[k + 1][3]
        if not inside or chunks[k + 1][0] - out[-1][0] > cd.WITHIN:
            out.append(c)
    return out


def plain_runs(rows, min_words):
    """Every column of every run, from lists of chunks; rows are (id, text)."""
    from collections import defaultdict

    distinct = sorted({(i, t) for i, t in rows if i is not None and t})
    chunks = {(i, t): thinned([(w, a, b, t.encode()[a:b]) for w, a, b in plain_chunks(t)]) for i, t in distinct}
    holders = defaultdict(set)
    for (i, _), cs in chunks.items():
        for *_, bytes_ in cs:
            holders[bytes_].add(i)
    found = {k: [c for c in cs if len(holders[c[3]]) > 1] for k, cs in chunks.items()}
    pairs = defaultdict(set)
    near = lambda cs: [(x, y) for y in cs for x in cs if 0 < y[0] - x[0] <= cd.WITHIN]
    for (i, _), cs in found.items():
        for x, y in near(cs):
            pairs[x[3], y[3], y[0] - x[0]].add(i)
    out = []

    def beside(t, word, left):
        """Words before or after a place with the space between, nearest first."""
        data = t.encode()
        edges = [m.span() for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", data)]
        marks = [e[0] for e in edges[max(0, word - cd.WITHIN) : word + 1]][::-1] if left else [e[1] for e in edges[word - 1 : word + cd.WITHIN]]
        return [(data[min(x, y) : max(x, y)], y) for x, y in zip(marks, marks[1:])]

    for (i, t), cs in found.items():
        links = [(x[0], y[0]) for x, y in near(cs) if len(pairs[x[3], y[3], y[0] - x[0]]) > 1]
        run: list = []
        for k, c in enumerate(cs):
            if run and not any(a <= cs[k - 1][0] and c[0] <= b for a, b in links):
                out.append((i, t, run))
                run = []
            run.append(c)
        if run:
            out.append((i, t, run))
    result = []
    for i, t, run in out:
        ends = []
        for left, c in ((True, run[0]), (False, run[-1])):
            have, best = holders[c[3]], (0, None)
            for mate in {min(have), max(have)} - {i}:
                places = []
                for (j, u), cs in found.items():
                    if j == mate:
                        signed = xxhash.xxh3_64_intdigest(u.encode())
                        signed -= (1 << 64) if signed >> 63 else 0
                        places += [(signed, d[0], u) for d in cs if d[3] == c[3]]
                _, at, u = min(places)
                word, theirs = (c[0], at) if left else (c[0] + cd.CHUNK_WORDS, at + cd.CHUNK_WORDS)
                n, byte = 0, None
                for (x, end), (y, _) in zip(beside(t, word, left), beside(u, theirs, left)):
                    if x != y:
                        break
                    n, byte = n + 1, end
                best = max(best, (n, byte), key=lambda e: e[0])
            ends.append(best)
        words = run[-1][0] + cd.CHUNK_WORDS - run[0][0] + ends[0][0] + ends[1][0]
        firsts = [min(holders[c[3]]) for c in run]
        if words >= min_words:
            result.append((i, ends[0][1] if ends[0][0] else run[0][1], ends[1][1] if ends[1][0] else run[-1][2], words, len(run), min(firsts), all(f == i for f in firsts)))
    return sorted(result)


def test_every_column_against_brute_force(spark, docs):
    rng = random.Random(31)
    pool = [passage(rng, n) for n in (20, 38, 45, 51, 70, 140)]
    texts = [" ".join(x for _ in range(rng.randrange(1, 4)) for x in (passage(rng, rng.randrange(0, 50)), rng.choice(pool))) for _ in range(50)]
    texts += [None, "", "x " * 90, "x " * 70, texts[0], texts[3], "a b c " * 40 + "d", "a b c " * 30]
    ids = [*range(50), 60, 61, 62, 63, 0, None, 64, 65]
    ids[7] = 6  # one id, two texts
    columns = "doc_id", "start_byte", "end_byte", "n_words", "n_chunks", "first_doc", "kept"
    for least in (cd.MIN_WORDS, cd.SURE_WORDS):
        got = sorted(tuple(r[c] for c in columns) for r in cd.repeated_runs(docs(texts, ids), min_words=least).collect())
        assert got == plain_runs(list(zip(ids, texts)), least) and len(got) > 20


def test_a_run_is_not_pieced_together(spark, docs):
    """Two passages that stand side by side in one document, and apart in others, are two runs, too short to report."""
    rng = random.Random(32)
    a, b = passage(rng, 40), passage(rng, 40)
    texts = [f"{passage(rng, 30)} {a} {b} {passage(rng, 30)}", f"{passage(rng, 30)} {a} {passage(rng, 30)}", f"{passage(rng, 30)} {b} {passage(rng, 30)}"]
    assert cd.repeated_runs(docs(texts), min_words=cd.SURE_WORDS).collect() == []
    together = texts + [f"{passage(rng, 30)} {a} {b} {passage(rng, 30)}"]
    assert {r.doc_id for r in cd.repeated_runs(docs(together), min_words=cd.SURE_WORDS).collect()} == {0, 3}


def test_clashing_columns_pass(spark):
    rng = random.Random(33)
    t = passage(rng, 80)
    df = spark.createDataFrame([(1, t, 5, "s"), (2, t, 6, "s"), (None, t, 7, "s")], "doc_id long, text string, _key long, _spans string")
    out = cd.drop_repeated_runs(df)
    assert out.columns == df.columns
    assert sorted((r._key, r.text) for r in out.collect()) == [(5, t), (6, ""), (7, t)]


def passage(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(n))


def test_planted_passages_are_found_and_clean_documents_left_alone(spark, docs):
    rng = random.Random(6)
    shared = [passage(rng, 55) for _ in range(6)]
    texts, want = [], set()
    for i in range(120):
        parts = [passage(rng, rng.randrange(5, 200))]
        if i % 3 == 0:
            parts.insert(rng.randrange(2), rng.choice(shared))
            want.add(i)
        if i % 5 == 0:
            parts.append("one short line that many hold")
        texts.append(" ".join(parts))
    rows = cd.repeated_runs(docs(texts)).collect()
    assert {r.doc_id for r in rows} == want
    for r in rows:
        span = texts[r.doc_id].encode()[r.start_byte : r.end_byte].decode()
        assert sum(span in t for t in texts) >= 2 and r.n_words >= cd.MIN_WORDS
        assert r.kept == (r.doc_id == r.first_doc)


def test_copies_are_cut_out(spark, docs):
    rng = random.Random(8)
    long, own = passage(rng, 80), passage(rng, 60)
    df = docs([long, own + " é " + long, None, "", long, long], ids=[5, 6, 7, 8, 9, 9])
    out = {(r.doc_id, r.text) for r in cd.drop_repeated_runs(df).collect()}
    kept = {i: t for i, t in out}
    assert kept[5] == long and kept[7] is None and kept[8] == "" and kept[9] == ""
    assert kept[6].startswith(own[:-40]) and len(kept[6]) < len(own) + 100
    assert cd.drop_repeated_runs(df).columns == df.columns


def test_defined_cases(spark, docs):
    rng = random.Random(9)
    t = passage(rng, 80)
    assert cd.repeated_runs(docs([])).collect() == []
    # one id, or null ids: no repeat across documents
    assert cd.repeated_runs(docs([t, t, t], ids=[1, 1, None])).collect() == []
    rows = cd.repeated_runs(docs([t, t, t], ids=[1, 2, 2])).collect()
    assert sorted((r.doc_id, r.kept) for r in rows) == [(1, True), (2, False)]
    assert {r.doc_id for r in cd.repeated_runs(docs([t * 30, t * 30])).collect()} == {0, 1}


def test_every_passage_of_51_words_is_found(spark, docs):
    rng = random.Random(11)
    short = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(1, 4))) for _ in range(n))
    texts = []
    for kind in (short, short, lambda n: passage(rng, n)):
        for _ in range(60):
            shared = kind(51)
            texts += [f"{passage(rng, rng.randrange(90))} {shared} {passage(rng, rng.randrange(90))}" for _ in range(2)]
    texts += ["For " * 51 + passage(rng, 40), passage(rng, 40) + " For" * 51]
    # the outer words are glued to others
    shared = short(51)
    texts += [f"x{shared}y", f"z{shared}"]
    assert {r.doc_id for r in cd.repeated_runs(docs(texts)).collect()} == set(range(len(texts)))


def test_what_is_reported_is_shared(spark, docs):
    rng = random.Random(12)
    shared = [passage(rng, n) for n in (30, 36, 51, 90)]
    texts = [f"{passage(rng, 40)} {s} {passage(rng, 40)}" for s in shared for _ in range(2)]
    rows = cd.repeated_runs(docs(texts)).collect()
    assert {r.doc_id for r in rows} == {4, 5, 6, 7}
    for r in rows:
        span = texts[r.doc_id].encode()[r.start_byte : r.end_byte].decode()
        assert span == shared[r.doc_id // 2] and r.n_words == len(span.split())
