"""The ledger engine: queries against DuckDB, scalars by table, repairs and matching against plain loops, the agent loop."""

import glob
import itertools
import os
import random
import time
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import headers, scalars
from tallyspark.operators import chunk, evalmetric, reconcile, retrieve, rows
from tallyspark.plans import agent, dialect, gold, registry
from tallyspark.sources import ledger

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, str, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    r = duck.execute(registry.oracle_sql()[name])
    at = [[x[0] for x in r.description].index(c) for c in df.columns]
    assert len(at) == len(r.description)
    want = sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
    assert sorted((tuple(map(plain, x)) for x in df.collect()), key=repr) == want


@pytest.mark.parametrize(("name", "table"), [("column_comma_fix", "lineitem"), ("cell_cleanup", "orders")])
def test_every_row_is_repaired(spark, name, table):
    assert registry.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def column(spark, f, values, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def test_scalars(spark):
    assert [x and float(x) for x in column(spark, scalars.parse_decimal, ["$1,234.50", "(12.5)", "NA", " none ", "5d", "₹7", "1e3", "", None])] == [1234.5, -12.5, None, None, None, 7.0, 1000.0, None, None]
    assert column(spark, scalars.parse_integer, ["12.7", "-12.7", "1,000", "x", "", None, "7"]) == [12, -12, 1000, None, None, None, 7]
    assert column(spark, scalars.parse_boolean, ["Yes", "off", "2", None, " T "]) == [True, False, None, None, True]
    assert [str(x) for x in column(spark, scalars.parse_date, ["03/04/2020", "2020-04-03", "3 Apr 99", "3-4-69", "31/02/2020", "n/a", None])] == ["2020-04-03", "2020-04-03", "1999-04-03", "1969-04-03", "None", "None", "None"]
    assert column(spark, scalars.is_float, ["1_000", "5d", "nan", "-inf", "1e5", ".5", "5.", "1,000", "", "+", None, "1__0"]) == [True, False, True, True, True, True, True, True, False, False, False, False]
    assert column(spark, scalars.unaccent, ["Crème brûlée Ø ß Æ"]) == ["Creme brulee O ss AE"]
    assert column(spark, lambda c: scalars.search_text(description=c), ["Éa", None]) == ["ea" + " " * 11, " " * 11]


def test_headers():
    assert headers.resolve("Branch") == ("branch_code",) and headers.resolve("Check") == ("cheque",) and headers.resolve("") is None
    assert headers.resolve("Ref / Cheque No") == ("reference", "cheque") and headers.resolve("Cheque and Ref") == ("cheque", "reference") and headers.resolve("x and y") is None


def test_cells(spark):
    assert column(spark, rows.clean_cell, ["a<br>b<br/>c<br />d<br  />", " 1.234.567,89 ", "1.2x.3"]) == ["a\nb\nc\nd<br  />", "1234.567,89", "1.2x.3"]
    assert column(spark, rows.rejoin_escaped, [["a\\", "b\\\\", "c"], ["x"], []], "array<string>") == [["abc"], ["x"], []]
    assert column(spark, lambda c: rows.trim_trailing(c, 2), [["a", "b", "", ""], ["a", "b", "c", ""], ["", "", ""]], "array<string>") == [["a", "b"], ["a", "b", "c"], ["", ""]]


def test_page_stitching_equals_a_loop(spark):
    rnd, want, data = random.Random(0), {}, []
    for f in range(150):
        pages = [[(rnd.random() < 0.6, f"{p}.{r}") for r in range(rnd.choice([1, 1, 1, 2]))] for p in range(rnd.randint(1, 7))]
        data += [(f"f{f}", 2 * p, r, [t], c) for p, rs in enumerate(pages) for r, (c, t) in enumerate(rs)]
        emitted = []
        for p, rs in enumerate(pages):
            rs = [list(x) for x in rs]
            if p and rs and rs[0][0] and emitted[-1][1]:
                emitted[-1][1][-1][1] += " " + rs[0][1]
                rs = rs[1:]
            emitted.append((p + 1, rs))
        want[f"f{f}"] = [(p, r[1]) for p, rs in emitted for r in rs]
    df = spark.createDataFrame(data, "file string, page int, row_idx int, cells array<string>, c boolean")
    got = {}
    for r in rows.stitch_pages(df, F.col("c")).orderBy("file", "page", "row_idx").collect():
        got.setdefault(r["file"], []).append((r["page_index"], r["cells"][0]))
    assert got == {k: v for k, v in want.items() if v}


def close(a, b):
    return abs(a - b) <= 1e-9 * max(abs(a), abs(b))


def loop(file, opening):
    """The reconciliation as a plain loop over one file's rows."""
    prev, out = opening, []

    def variants(v):
        s = str(abs(v))
        d, sign = s.replace(".", ""), -1 if v < 0 else 1
        return sorted({v, *(sign * float(d[:i] + "." + d[i:]) for i in range(1, len(d)))}) if v else [v]

    for i, (c, d, b) in enumerate(file):
        if c == d == 0 or c > 0 and d > 0:
            continue
        kind, out_row = None, (c, d, b)
        if close(b, prev + c - d):
            kind = "ok"
        elif min(c, d, b) < 0:
            for m in range(1, 8):
                t = tuple(v if m >> n & 1 else (-v if v <= 0 else v) for n, v in enumerate((c, d, b)))
                if close(t[2], prev + t[0] - t[1]):
                    kind, out_row = "sign", t
                    break
        if not kind:
            for t in itertools.product(variants(c), variants(d), variants(b)):
                if close(t[2], prev + t[0] - t[1]):
                    kind, out_row = "shift", t
                    break
        if not kind and close(b, prev + d - c):
            kind, out_row = "swap", (d, c, b)
        if not kind and i == 0 and close(b, opening):
            kind = "opening"
        out.append((i, kind or "unreconciled", *out_row))
        prev = b
    return [x for x in out if x[1] != "opening"]


def test_reconciliation_equals_a_loop(spark):
    rnd, want, data = random.Random(1), [], []
    for f in range(60):
        balance, file = 1000.5, []
        for _ in range(12):
            c, d = rnd.choice([(round(rnd.uniform(1, 9000), 2), 0.0), (0.0, round(rnd.uniform(1, 900), 2))])
            balance = round(balance + c - d, 2)
            k = rnd.randrange(9)
            file.append([(c, d, balance), (round(c * 10, 1), round(d * 10, 1), balance), (-c, -d, balance), (d, c, balance), (c, d, -balance), (0.0, 0.0, balance), (c + 1, d + 1, balance), (c, d, round(balance / 10, 3)), (c, d, balance)][k])
        data += [(f"f{f}", i, *map(float, r), 1000.5) for i, r in enumerate(file)]
        want += [(f"f{f}", *x) for x in loop([tuple(map(float, r)) for r in file], 1000.5)]
    df = spark.createDataFrame(data, "file string, row_idx int, credit double, debit double, balance double, opening_balance double")
    got = [(r["file"], r["row_idx"], r["repair_kind"], r["credit"], r["debit"], r["balance"]) for r in reconcile.reconcile(df).collect()]
    assert sorted(got) == sorted(want)


def test_overdrawn_balances_are_shifted_too(spark):
    df = spark.createDataFrame([("f", 0, 0.0, 10.0, -600.0, -50.0), ("g", 0, 0.0, 0.0, 5.0, 5.0), ("g", 1, 1.0, 0.0, 60.0, 5.0)], "file string, row_idx int, credit double, debit double, balance double, opening_balance double")
    got = {r["file"]: (r["repair_kind"], r["balance"]) for r in reconcile.reconcile(df).collect()}
    assert got == {"f": ("shift", -60.0), "g": ("shift", 6.0)}


def test_white_space_at_the_ends(spark):
    assert column(spark, rows.clean_cell, ["\n5 \t", "\u00a0x\r\n", "\x1c"]) == ["5", "x", ""]
    assert column(spark, scalars.to_float, ["\t5\n", "\u20031,000.5 "]) == [5.0, 1000.5]


def test_chunk_pack_equals_a_loop(spark):
    rnd = random.Random(2)
    lines = {p: [" ".join("w" * 1 for _ in range(rnd.randint(1, 14))) for _ in range(rnd.randint(1, 9))] for p in range(30)}
    df = spark.createDataFrame([(p, i, x) for p, ls in lines.items() for i, x in enumerate(ls)], "page int, i int, line string")
    got = {(r["page"], r["chunk_index"]): (r["n_rows"], r["body"]) for r in chunk.pack_rows(df, F.lit("h1 h2"), ["page"], ["i"], limit=15).collect()}
    want = {}
    for p, ls in lines.items():
        packs = [[]]
        for x in ls:
            if packs[-1] and 2 + sum(len(y.split()) for y in packs[-1]) + len(x.split()) > 15:
                packs.append([])
            packs[-1].append(x)
        want |= {(p, n): (len(k), "\n".join(["h1 h2", *k])) for n, k in enumerate(packs, 1)}
    assert got == want


def test_matching_is_maximum():
    rnd = random.Random(3)
    for _ in range(300):
        a, b = ([round(rnd.randrange(6) * 0.006, 3) for _ in range(rnd.randint(0, 5))] for _ in range(2))
        short, long = sorted((a, b), key=len)
        best = max((sum(abs(x - y) <= 0.01 + 1e-9 for x, y in zip(short, p)) for p in itertools.permutations(long, len(short))), default=0)
        v = sorted({*a, *b})
        assert evalmetric.matching(pd.DataFrame({"n": [[x] for x in v], "a": [a.count(x) for x in v], "b": [b.count(x) for x in v]})) == best


def test_matching_of_long_runs(spark):
    """Runs of thousands of rows without a gap; comparing every two of them, or one path a round, takes many minutes."""
    n = 20_000
    gold = spark.range(n).select((F.col("id") * 0.004).alias("x"), F.lit("a").alias("s"))
    pred = spark.range(n).select((F.col("id") * 0.004 + 0.0101).alias("x"), F.lit("A").alias("s"))
    began = time.perf_counter()
    assert tuple(evalmetric.tolerant_matches(pred, gold).first()) == (n - 1, 1, 1)  # row i in reach of rows i + 1 to i + 5
    rnd = random.Random(4)
    points = sorted({(rnd.randrange(9) * 0.004, rnd.randrange(4000) * 0.004) for _ in range(12_000)})
    p = pd.DataFrame({"n": [list(x) for x in points], "a": [1] * len(points), "b": [1] * len(points)})
    assert evalmetric.matching(p) == len(points)
    assert time.perf_counter() - began < 60


def test_matching_by_runs(spark):
    """Tables of one to three numbers, counts over runs against one flow over all rows."""
    rnd = random.Random(6)
    for width in (1, 2, 3):
        sides = [[("t" if rnd.random() < 0.8 else None, *(rnd.randrange(5) * 0.006 + rnd.randrange(4) for _ in range(width))) for _ in range(200)] for _ in range(2)]
        pred, gold = (spark.createDataFrame(r, "s string, " + ", ".join(f"x{i} double" for i in range(width))) for r in sides)
        best = 0
        for s in ("t", None):
            v = sorted({r[1:] for side in sides for r in side if r[0] == s})
            a, b = ([[r[1:] for r in side if r[0] == s].count(x) for x in v] for side in sides)
            best += evalmetric.matching(pd.DataFrame({"n": [list(x) for x in v], "a": a, "b": b}))
        assert tuple(evalmetric.tolerant_matches(pred, gold).first()) == (best, 200 - best, 200 - best)


def test_compare(spark):
    gold = spark.createDataFrame([(1, "a", 2.0, 0), (2, "b", 1.0, 1), (3, "c", 1.0, 2)], "id int, name string, x double, pos int")
    pred = spark.createDataFrame([("A ", 2.005, "1.0", 0), ("c", 1.0, "3", 1), ("b", 1.0, "2", 2)], "NAME string, x double, ID string, pos int")
    r = evalmetric.compare(pred, gold, "select * from t order by t.x desc limit 3", True, "pos")
    assert (r["tp"], r["fp"], r["fn"], r["order_satisfied"], r["execution_accuracy"]) == (3, 0, 0, 1, 1)
    bad = pred.withColumn("pos", 9 - F.col("pos"))
    assert evalmetric.compare(bad, gold, "select * from t order by x desc", True, "pos")["execution_accuracy"] == 0
    none = spark.createDataFrame([("No query results returned",)], "message string")
    assert evalmetric.compare(none, gold.limit(0))["execution_accuracy"] == 1
    assert evalmetric.compare(gold.select("id"), gold.drop("pos"))["fp"] == 3


def test_order_of_answers(spark):
    gold = spark.createDataFrame([("a", 3, 0), ("b", 2, 1), ("c", 1, 2)], "name string, amount int, pos int")
    turned = gold.withColumn("pos", 2 - F.col("pos"))
    for sql in ("select name, amount from t order by Amount desc", "select name, amount from t order by 2 desc", "select * from t order by other"):
        good, bad = (evalmetric.compare(x, gold, sql, True, "pos") for x in (gold, turned))
        assert (good["execution_accuracy"], bad["execution_accuracy"], bad["exact_match"]) == (1, 0, 1), sql
    named = turned.toDF("who", "how_much", "pos")
    assert evalmetric.compare(named, gold, "select name, amount from t order by amount desc", True, "pos")["order_satisfied"] == 0
    assert evalmetric.compare(gold.toDF("who", "how_much", "pos"), gold, "order by amount", True, "pos")["execution_accuracy"] == 1
    assert evalmetric.compare(gold.limit(0), gold, "order by amount", True, "pos")["order_satisfied"] == 1
    wide = evalmetric.compare(gold.withColumn("more", F.lit(1)), gold, "order by amount", True, "pos")
    assert (wide["tp"], wide["order_satisfied"]) == (0, 0)


def test_texts_that_are_numbers(spark):
    def same(x, y):
        one = lambda v: spark.createDataFrame([(v,)], "v string")
        return evalmetric.compare(one(x), one(y))["exact_match"] == 1

    assert same("100000", "100000.0") and same(" 1_000\n", "1000") and same("1.5e3", "1500")
    assert not same("1e5", "100000") and same("NaN", "nan") and not same("1e5", "100000.0")


def test_near_scores_rank_by_the_full_score(spark):
    from tallyspark.operators import retrieve

    e = spark.createDataFrame([(1, [1.0, 0.0011]), (2, [1.0, 0.0010]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [r["vec_id"] for r in retrieve.top_k(e, q, 2).orderBy("rank").collect()] == [2, 1]


def test_metrics_by_label(spark):
    """As from the pairs of the judgements, which aren't made; a label of no other document and one that isn't found, too."""
    docs = spark.createDataFrame([(i, i % 4 if i < 29 else 9) for i in range(31)] + [(31, None)], "doc_id int, label int")
    queries = spark.createDataFrame([(0, 0), (1, 1), (29, 9), (2, 2), (7, None)], "query_id int, label int")
    run = spark.createDataFrame([(q, (q + 3 * d) % 32, 1.0 / (1 + d // 2)) for q in (0, 1, 29, 7) for d in range(12)], "query_id int, doc_id int, score double")
    qrels = queries.join(docs, "label").select("query_id", "doc_id", F.lit(1).alias("rel"))
    assert retrieve.ir_metrics_by_label(run, queries, docs).collect() == retrieve.ir_metrics(run, qrels).collect()


def test_top_k_holds_one_tile():
    """Best rows as a full sort gives them, ties and NaN too; the scores of all queries and rows are never held at once."""
    rng = np.random.default_rng(0)
    v = rng.normal(size=(3_000, 4)).round(1)  # many equal vectors
    v[3], v[4, 2] = 0, np.nan
    p = pd.DataFrame({"k_": rng.permutation(3_000), "v_": list(v)})
    q = retrieve.unit(p["v_"][:300])
    found = pd.concat(retrieve.best_rows(iter([p[:1_000], p[1_000:1_000], p[1_000:]]), np.arange(300), q, 20))
    scores = np.round(q @ retrieve.unit(p["v_"]).T, 12)
    for i, y in enumerate(scores):
        best = np.lexsort((p["k_"], np.where(np.isnan(y), -np.inf, -y)))[:20]
        assert found["k_"][found["q_"] == i].tolist() == p["k_"].to_numpy()[best].tolist()
    p = pd.DataFrame({"k_": np.arange(10_000), "v_": list(rng.normal(size=(10_000, 4)))})
    tracemalloc.start()
    list(retrieve.best_rows(iter([p]), np.arange(4_096), retrieve.unit(p["v_"][:4_096]), 20))
    assert tracemalloc.get_traced_memory()[1] < 100e6  # one matrix of scores would be 328 MB
    tracemalloc.stop()


def test_standardised_table(spark):
    from tallyspark.operators.standardise import COLUMNS, standardise

    df = spark.createDataFrame([("03/04/2020", "$1,234.50", "-", "123456 / AB", "\tpaid "), ("x", "", "(7)", "AB12", None)], "`Date` string, `Debit` string, `Credit` string, `Cheque / Reference` string, `Description` string")
    out = standardise(df)
    assert out.columns == [f.name for f in COLUMNS]
    a, b = out.orderBy(F.col("date").desc_nulls_last()).collect()
    assert (str(a["date"]), float(a["debit"]), a["credit"], a["cheque"], a["reference"], a["description"]) == ("2020-04-03", 1234.5, None, "123456", "AB", "paid")
    assert (b["date"], b["debit"], float(b["credit"]), b["description"], b["bank_name"]) == (None, None, -7.0, None, None)


def test_files_and_metadata(spark, tmp_path):
    rows_ = spark.createDataFrame([("f", 1, None), ("g", 2, "own")], "file string, n int, bank_name string")
    meta = spark.createDataFrame([("f", "known", "77"), ("g", "known", "88")], "file string, bank_name string, account_no string")
    assert sorted(map(tuple, ledger.attach_metadata(rows_, meta).select("file", "n", "bank_name", "account_no").collect())) == [("f", 1, "known", "77"), ("g", 2, "own", "88")]
    t = lambda x: spark.createDataFrame([(0, [x])], "row_idx int, cells array<string>")
    header, both = ledger.any_header([(None, t("a")), (["h"], t("b")), (["i"], t("c"))])
    assert header == ["h"] and sorted((r["table_idx"], r["cells"][0]) for r in both.collect()) == [(0, "a"), (1, "b"), (2, "c")]
    assert ledger.answer(rows_.withColumn("search_text", F.lit(1)).withColumn("ID", F.lit(1))).columns == rows_.columns
    assert ledger.read_results(spark, str(tmp_path / "none")) is None
    ledger.write_results(rows_, str(tmp_path / "r"))
    assert ledger.read_results(spark, str(tmp_path / "r")).count() == 2
    (tmp_path / "q.json").write_text('[{"id": "z"}, {"id": "a"}, {"id": "m"}]')
    assert [(r["q_num"], r["id"]) for r in ledger.read_questions(spark, str(tmp_path / "q.json")).orderBy("q_num").collect()] == [(1, "z"), (2, "a"), (3, "m")]


def test_order_key():
    assert evalmetric.order_key("select a from t order by sum(t.Amount) desc nulls last, b limit 5") == "amount"
    assert evalmetric.order_key("select 1 -- order by x") is None and evalmetric.order_key("select a from t order by 1") is None


def test_dialect_traps(spark):
    spark.createDataFrame([(1, None, "2024-05-31"), (2, 5, "2024-06-07"), (3, 9, None)], "k int, v int, d string").selectExpr("k", "v", "cast(d as date) as date").createOrReplaceTempView("t")
    run = lambda q: [tuple(r) for r in dialect.run(spark, q).collect()]
    assert run("SELECT k FROM t ORDER BY v DESC") == [(1,), (3,), (2,)]
    assert run("SELECT k FROM t ORDER BY v, k DESC LIMIT 2") == [(2,), (3,)]
    assert run("SELECT k FROM t WHERE extract(dow from date) = 5") == [(1,), (2,)]
    assert run("SELECT to_char(date, 'MM-DD') FROM t WHERE k = 2") == [("06-07",)]
    assert run("SELECT 'date - value_date' AS a, 'x ORDER BY y' AS b, 'a ~* ''b''' AS c, '7 / 2' AS e FROM t ORDER BY k LIMIT 1") == [("date - value_date", "x ORDER BY y", "a ~* 'b'", "7 / 2")]
    assert run("SELECT 7 / 2 AS a, count(*) / 2 AS b FROM t") == [(3, 1)] and float(run("SELECT 7 / 2.0 AS c")[0][0]) == 3.5
    assert run("SELECT k FROM t WHERE 'Big MIT' ~* '\\mmit\\M' AND NOT 'x' ~ 'y' AND k = 1") == [(1,)]
    assert run("SELECT (date_trunc('month', date) + interval '1 month - 1 day')::date = date FROM t WHERE k = 1") == [(True,)]
    for bad in ("DELETE FROM t", "/* x */ drop table t", "CREATE TABLE x AS SELECT 1", "SHOW TABLES", "SELECT 1; SELECT 2", "SET a=b"):
        assert dialect.read_only(spark, bad), bad
    for good in ("SELECT replace('update', 'u', 'x')", "SELECT 'drop table' AS x -- delete", "WITH a AS (SELECT 1 AS x) SELECT * FROM a"):
        assert dialect.read_only(spark, good) is None, good


G, V = agent.Generated, agent.Validation


@pytest.mark.parametrize(
    "answers, checks, want",
    [
        ([G("SELECT 1 AS x")], [V(True)], ("SELECT 1 AS x", True, 1)),
        ([ValueError("down"), G(""), G("SELECT 2 AS x")], [V(True)], ("SELECT 2 AS x", True, 3)),
        ([G("DROP TABLE t"), G("SELECT 3 AS x")], [V(True)], ("SELECT 3 AS x", True, 2)),
        ([G("SELECT 4 AS x"), G("SELECT 5 AS x")], [ValueError("down"), V(True)], ("SELECT 5 AS x", True, 2)),
        ([G("SELECT 6 AS x")], [V(False, "no", "SELECT 7 AS x"), V(True)], ("SELECT 7 AS x", True, 2)),
        ([G("SELECT 8 AS x")], [V(False, "no")] * 5, ("SELECT 8 AS x", False, 5)),
        ([G("SELEC")] * 5, [], ("", False, 5)),
    ],
)
def test_agent_loop(spark, answers, checks, want):
    r = agent.Agent(spark, agent.Scripted(answers, checks), "schema").run("q", correct=True)
    assert (r.query, r.metadata["validation_passed"], r.metadata["attempts"]) == want


def test_agent_once_and_strategies(spark):
    r = agent.Agent(spark, agent.Scripted([G("SELECT 1 AS x")]), "s").run("q")
    assert r.total_count == 1
    assert "error" in agent.Agent(spark, agent.Scripted([G("INSERT INTO t VALUES (1)")]), "s").run("q").metadata
    assert [agent.Strategy.named(n) for n in agent.STRATEGIES] == [agent.Strategy(*x) for x in ((None, False), ("unstructured", False), ("structured", False), (None, True), ("structured", True))]


def test_retrying_clients():
    class Bad:
        def generate(self, prompt):
            raise ValueError("gone")

    good = agent.Scripted([G("ok")])
    r = agent.Retrying([Bad(), good], gone=lambda e: "gone" in str(e), sleep=lambda s: None)
    assert r.generate("p").query == "ok" and r.clients == [good]


def test_sources(spark, tmp_path):
    t = ledger.transactions(spark, SF).limit(20).withColumn("file_name", F.lit("a.pdf"))
    out = str(tmp_path / "t")
    ledger.append(t, out)
    back = spark.read.parquet(out)
    assert back.columns == ledger.SCHEMA.fieldNames() and back.count() == 20
    assert ledger.not_yet_ingested(t, back).count() == 0
    c = spark.createDataFrame([("c_1", 'x,"y"\nz', "a_page_1.png", None)], "chunk_id string, text_description string, image_filename string, query string")
    ledger.write_corpus(c, str(tmp_path / "c"))
    assert ledger.read_corpus(spark, str(tmp_path / "c")).first()["text_description"] == 'x,"y"\nz'
    (tmp_path / "o.json").write_text('[{"pages": [{"items": [{"type": "text"}, {"type": "table", "rows": [["a", null], ["b", "c"]]}]}]}]')
    assert [r["cells"] for r in ledger.ocr_rows(spark, str(tmp_path / "o.json")).orderBy("row_idx").collect()] == [["a", None], ["b", "c"]]
    both = ledger.combine([spark.createDataFrame([(1,)], "`a ` int"), spark.createDataFrame([(2,)], "b int")], ["x", "y"])
    assert both.columns == ["a", "File Name", "b"]


def test_rows_without_a_date_go(spark):
    df = spark.createDataFrame([(0, ["x", "12.5", None]), (1, ["2024", "03/04/2024"]), (2, []), (3, None), (4, ["5 Mar 2023 "])], "i int, cells array<string>")
    got = {r["i"]: r["d"] for r in df.select("i", reconcile.has_date(F.col("cells")).alias("d")).collect()}
    assert got == {0: False, 1: True, 2: False, 3: False, 4: True}
    data = [("f", 0, 9.0, 0.0, 500.0, 0.0, ["a"]), ("f", 1, 7.0, 0.0, 900.0, 0.0, ["1/2/2024"])]
    r = spark.createDataFrame(data, "file string, row_idx int, credit double, debit double, balance double, opening_balance double, cells array<string>")
    assert [(x["row_idx"], x["repair_kind"]) for x in reconcile.reconcile(r, reconcile.has_date(F.col("cells"))).collect()] == [(1, "unreconciled")]


def test_statement_chunks(spark):
    data = [("d/a.b.pdf", 1, 2, "two, 2", None), ("d/a.b.pdf", 1, 1, "one", None), ("d/a.b.pdf", 2, 3, None, None), ("c.pdf", 1, 1, "x y z", "k"), (None, 1, 1, "q", None)]
    df = spark.createDataFrame(data, "`File Name` string, Page int, Serial int, text string, cheque string")
    got = {r["chunk_id"]: (r["text_description"], r["image_filename"], r["query"]) for r in chunk.statement_chunks(df).collect()}
    assert got == {
        "a.b_page_1_chunk_1": ('Page,Serial,text\n1,1,one\n1,2,"two, 2"', "a.b_page_1.png", ""),
        "a.b_page_2_chunk_1": ("Page,Serial,text\n2,3,", "a.b_page_2.png", ""),
        "c_page_1_chunk_1": ("Page,Serial,text,cheque\n1,1,x y z,k", "c_page_1.png", ""),
        "unknown_statement_page_1_chunk_1": ("Page,Serial,text\n1,1,q", "unknown_statement_page_1.png", ""),
    }
    assert sorted(r["chunk_id"] for r in chunk.statement_chunks(df, limit=2).collect() if r["chunk_id"].startswith("a.b_page_1")) == ["a.b_page_1_chunk_1", "a.b_page_1_chunk_2"]
    assert chunk.statement_chunks(df.limit(0)).count() == 0
    assert [r["chunk_id"] for r in chunk.statement_chunks(spark.createDataFrame([("v",)], "t string")).collect()] == ["unknown_statement_page_1_chunk_1"]


def test_views(spark):
    c = spark.createDataFrame([("c1", "The Cash, the cash")], "chunk_id string, text_description string")
    assert retrieve.view(c).first()["text"] == "The Cash, the cash"
    assert retrieve.view(c, "bm25").first()["tokens"] == ["cash", "cash"]
    assert retrieve.view(c, "dense", lambda t: F.array(F.length(t))).first()["embedding"] == [18]
    for kind in ("dense", "other"):
        with pytest.raises(ValueError):
            retrieve.view(c, kind)


def test_cache(spark, tmp_path):
    path, made = str(tmp_path / "k"), []

    def make(n):
        made.append(n)
        return spark.range(n)

    assert ledger.cached(spark, path, lambda: make(0)).count() == 0
    assert ledger.cached(spark, path, lambda: make(3)).count() == 3
    assert ledger.cached(spark, path, lambda: make(5)).count() == 3 and made == [0, 3]
    for f in glob.glob(path + "/*.parquet") + glob.glob(path + "/.*.crc"):
        os.remove(f)
    (tmp_path / "k" / "part-0.parquet").write_text("no parquet")
    assert ledger.cached(spark, path, lambda: make(7)).count() == 7


def test_gold_answers(spark, tmp_path):
    qs = [{"id": "A_1", "ground_truth_sql": "SELECT 1 AS x, TIMESTAMP '2024-01-02 03:04:05' AS t"}, {"id": "A_2", "ground_truth_sql": "SELECT 1 AS x WHERE false"}, {"id": "A_3", "ground_truth_sql": "SELECT no_such"}, {"id": "A_4"}]
    folder = str(tmp_path)
    got = gold.materialise(spark, qs, folder)
    assert {k: v.split(":")[0] for k, v in got.items()} == {"A_1": "written", "A_2": "written", "A_3": "failed", "A_4": "no sql"}
    assert ledger.read_results(spark, folder + "/A_1").dtypes == [("x", "int"), ("t", "timestamp_ntz")]
    assert ledger.read_results(spark, folder + "/A_2").columns == ["x"] and ledger.read_results(spark, folder + "/A_3") is None
    assert set(gold.materialise(spark, qs[:2], folder).values()) == {"kept"}
    assert gold.materialise(spark, qs, folder, force=True, limit=1) == {"A_1": "written"}
