import random
import re
import sys
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

from quarryline.llm.line_dedup import DEPTH, MIN_DOCUMENTS, SHORT_DOCUMENTS, SQL, drop_recurring_lines, op4_line_dedup

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import connect, differences  # noqa: E402


def test_query_equals_sql(spark, sf_dir):
    assert differences(op4_line_dedup(spark, sf_dir), connect(sf_dir), SQL) == ""


def against_sql(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, drop_recurring_lines(docs).select("doc_id", "n_lines", "n_dropped", "text").collect()), key=str)
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    for r in rows:
        con.execute("INSERT INTO documents VALUES (?, ?)", r)
    assert got == sorted(map(tuple, con.sql(SQL).fetchall()), key=str)
    stays = model(rows)
    assert all(r[3] == (None if t is None else stays[t]) for r, (_, t) in zip(sorted(got, key=lambda r: str(r[0])), sorted(rows, key=lambda r: str(r[0])), strict=True) if r[0] is not None)
    return {r[0]: r for r in got}


def model(rows):
    """The rule by plain loops over the rows' texts: the texts that stay, by text."""
    texts = sorted({t for _, t in rows if t is not None})
    lines, texts_of, company = {}, defaultdict(set), defaultdict(dict)
    for t in texts:
        own = []
        for pos, line in enumerate(t.split("\n")):
            words = re.sub("[0-9]+", "<*>", line).replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
            words = [w for w in words if w]
            if any(c.isalpha() for w in words for c in w):
                own.append((pos, (len(words), *words[:8]), tuple(words[:4])))
        lines[t] = own
        for i, (_, leaf, _) in enumerate(own):
            texts_of[leaf].add(t)
            company[leaf].setdefault(t, (own[i - 1][2] if i else None, own[i + 1][2] if i + 1 < len(own) else None))
    frequent = {k for k, ts in texts_of.items() if len(ts) >= (20 if k[0] < 3 else 5)}

    def opened(leaf, side):
        n = len({c[side] for c in company[leaf].values()})
        return n >= 5 and n * 5 >= len(company[leaf])

    out = {}
    for t in texts:
        own, gone, block = lines[t], set(), []

        def close():
            if block and (opened(block[0][1], 0) or opened(block[-1][1], 1)):  # noqa: B023
                gone.update(pos for pos, _ in block)  # noqa: B023
            block.clear()  # noqa: B023

        for pos, leaf, _ in own:
            if leaf not in frequent:
                close()
                continue
            if block and (opened(block[-1][1], 1) or opened(leaf, 0)):
                close()
            block.append((pos, leaf))
        close()
        out[t] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
    return out


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))


def own(i, k):
    return " ".join(f"{chr(97 + (i * 7 + j) % 26)}{i}w{k}x{j}y" for j in range(12))


def test_templates_with_variable_fields_go_and_the_rest_stays(spark):
    n = MIN_DOCUMENTS + 1
    passage = " ".join(f"p{'abcdefghij'[j % 10]}{'klmnop'[j % 6]}" for j in range(55))
    rows = [(i, f"Page {i} of {i * 3} of this site\n{own(i, 'a')}\n{passage}\n{own(i, 'b')}\n\nok then") for i in range(n)]
    got = against_sql(spark, rows)
    for i in range(n):
        assert got[i] == (i, 6, 2, f"{own(i, 'a')}\n{own(i, 'b')}\n\nok then")


def test_lines_of_copied_documents_stay(spark):
    text = "\n".join(own(77, k) for k in "abcdefgh")
    near = [text.replace(f"w{k}x3y", f"edit{i}") for i, k in enumerate("abcdefgh")]
    got = against_sql(spark, [(i, text) for i in range(20)] + [(100 + i, t) for i, t in enumerate(near)])
    assert all(r[2] == 0 for r in got.values())


def test_what_follows_the_leading_tokens_is_variable(spark):
    lead = " ".join(f"lead{'abcdefgh'[j]}" for j in range(DEPTH))
    rows = [(i, f"{own(i, 'a')}\n{lead} tail{chr(97 + i)}\n{own(i, 'b')}") for i in range(MIN_DOCUMENTS)]
    rows += [(50, f"{own(50, 'a')}\n{lead} two more\n{own(50, 'b')}")]
    got = against_sql(spark, rows)
    assert [got[i][2] for i in range(MIN_DOCUMENTS)] == [1] * MIN_DOCUMENTS and got[50][2] == 0


@pytest.mark.parametrize("where, blank", [("start", False), ("middle", True), ("end", False), ("end", True)])
def test_blocks_of_2_to_10_lines_go_whole(spark, where, blank):
    rng, rows, want = random.Random(3), [], {}
    for n in range(2, 11):
        block = [prose(rng, rng.randint(3, 12)) for _ in range(n)]
        for i in range(50):
            a, b = prose(rng, 12), prose(rng, 9)
            parts = {"start": [*block, a], "middle": [a, *block, b], "end": [a, *block]}[where]
            rows.append((1000 * n + i, ("\n\n" if blank else "\n").join(parts)))
            want[1000 * n + i] = n
    got = against_sql(spark, rows)
    assert {i: r[2] for i, r in got.items()} == want


def test_edited_copies_stay_beside_boilerplate_that_goes(spark):
    rng, foot = random.Random(5), ["All of this belongs to its many authors", "Write to us at the usual place"]
    base = [prose(rng, rng.randint(9, 30)) for _ in range(20)]

    def edited():
        words = [[rng.choice([w, prose(rng, 1)]) if rng.random() < 0.03 else w for w in x.split(" ")] for x in base]
        return [" ".join(x) for x in words]

    rows = [(i, "\n".join([*edited(), *foot])) for i in range(300)]
    rows += [(1000 + i, "\n".join([*(prose(rng, 10) for _ in range(4)), *foot])) for i in range(120)]
    got = against_sql(spark, rows)
    assert all(r[2] == 2 for r in got.values())  # in copies as well as elsewhere, and nothing else of either


def test_short_lines_go_where_many_texts_have_them(spark):
    rng = random.Random(7)
    rows = [(i, f"{prose(rng, 8)}\nRead more\n{i}\n{prose(rng, 8)}") for i in range(SHORT_DOCUMENTS)]
    assert all(r[2] == 1 for r in against_sql(spark, rows).values())
    assert all(r[2] == 0 for r in against_sql(spark, rows[1:]).values())


def test_a_text_of_very_many_lines_takes_linear_time(spark):
    rng = random.Random(9)
    block = prose(rng, 6)
    rows = [(i, f"{prose(rng, 6)}\n{block}\n{prose(rng, 6)}") for i in range(6)]
    rows.append((99, f"{prose(rng, 6)}\n{block}\n{prose(rng, 5)}\n" * 100_000))
    out = drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.where("doc_id = 99").select("n_lines", "n_dropped").first() == (300_001, 100_000)


def test_edge_rows(spark):
    long = "\n".join(own(i, "z") for i in range(20_000))
    line = "all of this comes again and again"
    rows = [(None, None), (1, ""), (2, "\n\n"), (3, long), (3, long), (None, f"{own(1, 'q')}\n{line}")]
    rows += [(10 + i, f"{own(200 + i, 'r')}\n{line}\n {line}\t\n{own(300 + i, 's')}") for i in range(MIN_DOCUMENTS)]
    rows += [(60, f"{line}"), (61, f"\x0b{line}")]
    got = against_sql(spark, rows)
    assert got[1][1:] == (1, 0, "") and got[2][1:] == (3, 0, "\n\n") and got[60][1:] == (1, 1, "")
    docs = spark.createDataFrame([(i, t, "k", 7) for i, t in rows], "doc_id long, text string, drop string, n_lines int")
    out = drop_recurring_lines(docs)
    assert out.columns == ["doc_id", "text", "drop", "n_lines", "_n_lines", "n_dropped"] and out.count() == len(rows)
    assert {r["drop"] for r in out.collect()} == {"k"}
    assert drop_recurring_lines(docs.limit(0)).count() == 0
