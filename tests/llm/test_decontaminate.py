import re

from dagbag.llm import decontaminate
from tests.llm.conftest import CLASHES, prose

ITEMS = [(0, prose(50, 20)), (1, prose(51, 6)), (2, "too short"), (3, None), (None, prose(52, 12)), (5, prose(50, 20)), (6, "?!"), (7, "Какой это ГОРОД"), (8, prose(53, 5))]


def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


def brute(text, n=8, least=5):
    """Words (by number) that are in a window of an item, and the items."""
    norm = lambda t: re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (t or "").lower())
    words, hit, items = norm(text), set(), set()
    lines = [i for i, x in enumerate((text or "").split("\n")) for _ in norm(x)]
    for item, t in ITEMS:
        w = norm(t)
        k = min(n, len(w))
        if not w:
            continue
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for i in range(len(words) - k + 1):
            whole = (i == 0 or lines[i - 1] < lines[i]) and (i + k == len(words) or lines[i + k - 1] < lines[i + k])
            if tuple(words[i : i + k]) in grams and (k >= least or whole):
                hit |= set(range(i, i + k))
                items.add(-1 if item is None else item)
    return hit, sorted(items)


def texts():
    clean = [prose(i, 100) for i in range(4)]
    return [
        clean[0], clean[1] + "\n" + ITEMS[0][1].upper().replace(" ", ",  ") + " " + clean[2], ITEMS[1][1], clean[3][:200] + " " + ITEMS[4][1] + "! é " + ITEMS[1][1],
        "x " + ITEMS[0][1][:30], " ".join(ITEMS[0][1].split()[3:12]) + " " + clean[0], None, "",
        "it is too short here", clean[1] + "\n- Too SHORT!\n" + clean[2], "too short", "какой ЭТО город", clean[0] + " " + ITEMS[8][1] + "\nx",
    ]


def test_hits_match_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as action", "1 as items")
    got = {r.doc_id: r for r in decontaminate.report(df, benchmark(spark), gap=0).collect()}
    for d, t in rows:
        hit, items = brute(t)
        assert (d in got) == bool(hit)
        if hit:
            assert got[d].n_contaminated == len(hit) and got[d].items == items
    assert got[2].action == "remove document" and got[2].text is None
    cut = got[1]
    assert cut.action == "remove spans"
    (s,), (e,) = cut.starts, cut.ends
    assert rows[1][1][:s] + rows[1][1][e:] == cut.text
    # the same when the benchmark is too large for one broadcast
    parts = {r.doc_id: (r.starts, r.ends, r.items) for r in decontaminate.report(df, benchmark(spark), gap=0, limit=60).collect()}
    assert parts == {d: (r.starts, r.ends, r.items) for d, r in got.items()}


def test_clean_applies_the_report(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("'q' as item_id", "*")
    report = {r.doc_id: r for r in decontaminate.report(df, benchmark(spark)).collect()}
    out = decontaminate.clean(df, benchmark(spark))
    assert out.columns == df.columns
    left = {r.doc_id: r.text for r in out.collect()}
    for d, t in rows:
        if d in report and report[d].text is None:
            assert d not in left
        else:
            assert left[d] == (report[d].text if d in report else t)
            assert not brute(left[d])[0]
    parts = decontaminate.clean(df, benchmark(spark), limit=60)
    assert parts.columns == df.columns and {r.doc_id: r.text for r in parts.collect()} == left


def test_odd_rows(spark, odd_docs, no_docs):
    assert decontaminate.report(odd_docs, benchmark(spark)).count() == 0
    assert decontaminate.clean(odd_docs, benchmark(spark)).count() == 12
    leaky = odd_docs.unionByName(spark.createDataFrame([(70, "x y " + ITEMS[0][1], "", "", 0)] * 2, odd_docs.schema)).selectExpr("*", *CLASHES)
    for limit in (60, 1 << 20):
        out = decontaminate.clean(leaky, benchmark(spark), drop_share=1.0, limit=limit)
        assert out.columns == leaky.columns and out.count() == 14 and [r.text for r in out.collect() if r.doc_id == 70] == ["x y "] * 2
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.report(odd_docs, none).count() == 0 and decontaminate.clean(odd_docs, none).count() == 12
    assert decontaminate.report(no_docs, benchmark(spark)).count() == 0
    leak = spark.createDataFrame([(None, prose(9, 60) + " " + ITEMS[0][1]), (7, ITEMS[0][1]), (7, ITEMS[0][1])], "doc_id bigint, text string")
    assert sorted(str(r.doc_id) for r in decontaminate.report(leak, benchmark(spark)).collect()) == ["7", "7", "None"]


def test_oracle_in_sql_agrees_on_short_items_and_lines(spark):
    """What the tables at hand lack."""
    import duckdb
    import pandas as pd

    rows = list(enumerate(texts()))
    docs, items = pd.DataFrame(rows, columns=["doc_id", "text"]), pd.DataFrame(ITEMS, columns=["item_id", "text"]).astype({"item_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", docs), con.register("benchmark", items)
    want = {r[0]: r[1:] for r in con.sql(decontaminate.ORACLE).fetchall()}
    got = {r.doc_id: tuple(",".join(map(str, x)) if isinstance(x, list) else x for x in r[1:]) for r in decontaminate.report(spark.createDataFrame(rows, "doc_id bigint, text string"), benchmark(spark)).collect()}
    assert got == want and len(got) > 6
