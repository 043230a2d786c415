"""Findings of the third round, on small inputs that show what larger tables would."""

import random
import time

import duckdb
from pyspark.sql import functions as F

from tallyloom.operators import duplicates, identity, sanctions, steps, sweep
from tallyloom.operators import relational as R
from tallyloom.plans import registry
from tallyloom.session import spread
from tallyloom.sources import readers


def test_title_cut_inside_a_reference():
    """a reference without its end is no reference; whole ones are written out."""
    title, links, rows = readers.outline('<title>R&amp;D &lt;b&gt; A&amp</title><a href="/x?a=1&lt=2&amp;b=3">x</a><tr><td>1 &am</td></tr>')
    assert title == "R&D <b> A&amp"
    assert links == ["/x?a=1&lt=2&b=3"] and rows == [["1 &am"]]


def test_page_titles_are_what_the_sql_tells(spark, tmp_path):
    html = "<title> Cut &quot;a&quot; &lt;b&gt;&amp;amp; ver&amp</title><table><tr><td>x</td></tr></table>"
    duckdb.sql("select 1::bigint as page_id, 'u' as url, ? as html", params=[html]).write_parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    want = con.execute(registry.oracle_sql()["a08_page_outline"]).fetchall()
    assert [tuple(r) for r in registry.queries()["a08_page_outline"](spark, str(tmp_path)).collect()] == want
    assert readers.outline(html)[0] == 'Cut "a" <b>&amp; ver&amp'


def test_one_name_of_many_is_asked_once(spark):
    """F8: everybody bears one name; pairing all with all would be 1.6 billion pairs."""
    n = 40_000
    p = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") == 7, "Ion Altul").otherwise("Ana Pop").alias("name"))
    began = time.perf_counter()
    got = identity.match_by_name(p, p.withColumnRenamed("k", "member"), "name", "member").groupBy("member", "ambiguous").count().collect()
    assert {(r.member, r.ambiguous, r["count"]) for r in got} == {(7, False, 1), (None, True, n - 1)}
    assert time.perf_counter() - began < 60


def test_seats_that_many_hold_pair_only_fitting_names(spark):
    """one seat with many members of common words; what fits is what comparing all with all finds."""
    words = ["ana", "ion", "pop", "radu", "vlad", "zoe", "dan"]
    rnd = random.Random(5)
    names = [[rnd.sample(words, rnd.randint(2, 4)) for _ in range(60)] for _ in range(2)]
    frames = [spark.createDataFrame([(f"{k}{i}", w, "s") for i, w in enumerate(names[j])], f"{k} string, w{k} array<string>, seat string") for j, k in enumerate("ab")]
    want = {(f"a{i}", f"b{j}") for i, x in enumerate(names[0]) for j, y in enumerate(names[1]) if set(x) <= set(y) or set(y) <= set(x)}
    assert want and {tuple(r) for r in identity._names_held(*frames, ["seat"]).collect()} == want
    many = [spark.range(20_000).select(F.concat(F.lit(k), "id").alias(k), F.array(F.lit("ana"), F.lit("pop"), F.concat(F.lit("z"), "id")).alias(f"w{k}"), F.lit("s").alias("seat")) for k in "ab"]
    began = time.perf_counter()
    assert identity._names_held(*many, ["seat"]).count() == 20_000
    assert time.perf_counter() - began < 60


def test_long_texts_are_cut_into_runs_in_time_with_their_length(spark):
    """every run was counted off from the text's begin."""
    long = "ab \n" * 250_000
    texts = [(1, long + "xyz"), (2, long), (3, None), (4, ""), (5, "ăș𝒳x"), (5, "ăș𝒳x")]
    names = [("xyz",), ("b \na",), ("ș𝒳x",), ("x",), ("\n",), ("",), (None,), ("zz",)]
    began = time.perf_counter()
    found = R.holding(spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame(names, "n string"), "t", "n").select("k", "n").collect()
    assert sorted(map(tuple, found)) == sorted((k, n) for k, t in texts for (n,) in names if t and n and n in t)
    assert time.perf_counter() - began < 60


def test_sanctions_are_told_once_and_in_many_tasks(spark):
    """pages lay in as many tasks as the orders' file has row groups, were joined with themselves, and each fact held those that it goes by."""
    page = "<b>3 mai 2022 - Atenționarea domnului deputat Ion Pop</b><hr><b> </b><hr><i>x</i><hr><b>3 mai 2022 - Atenționarea domnului deputat Ion Pop</b><a href='/s.htm'>stenograma</a>"
    df = spark.createDataFrame([(1, page), (1, page), (2, None), (3, "")], "legislature long, html string")
    rows = sanctions.sanctions(df)
    assert [(r.legislature, r["at"], r.name, r.kind, str(r.held_on)) for r in rows.orderBy("at").collect()] == [(1, at, "Ion Pop", "warning", "2022-05-03") for at in (0, 0, 3, 3)]
    assert rows.select("id").distinct().count() == 2
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("zece") <= 8
    filled = registry.queries()["j13_sanctions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in filled and "Join" not in filled


def test_figures_of_overlaps_make_no_pairs(spark):
    """everything overlaps; pairing would be 1.6 billion pairs. Small ones match brute force."""
    rnd = random.Random(8)
    span = lambda: (s := rnd.randint(-40, 40), s + rnd.randint(-2, 30))
    a, b = [(i, *span()) for i in range(40)], [(rnd.choice(["x", "y", None]), *span()) for _ in range(60)]
    want = {}
    for i, s, e in a:
        for k, bs, be in b:
            if s <= e and bs <= be and s <= be and bs <= e:
                n, shared = want.get((i, k), (0, 0))
                want[i, k] = n + 1, shared + min(e, be) - max(s, bs)
    frames = spark.createDataFrame(a, "i int, s long, e long"), spark.createDataFrame(b, "k string, bs long, be long")
    got = sweep.overlap_totals(*frames, ("s", "e"), ("bs", "be"), 8, "k").collect()
    assert len(got) == len(want) and {(r.i, r.k): (r.n, r.shared) for r in got} == want
    n = 40_000
    many = spark.range(n).selectExpr("id as i", "id % 1000 as s", "id % 1000 + 2000 as e"), spark.range(n).selectExpr("'x' as k", "id % 1000 as bs", "id % 1000 + 2000 as be")
    began = time.perf_counter()
    assert sweep.overlap_totals(*many, ("s", "e"), ("bs", "be"), 64, "k").agg(F.sum("n")).first()[0] == n * n
    assert time.perf_counter() - began < 60


def test_common_fingerprints_alone_make_no_pairs(spark):
    """All share one common fingerprint, and many a second one that is as common, but no two the both."""
    n = 20_000
    df = spark.range(n).select("id", F.array(F.concat(F.lit("a"), (F.col("id") % 2).cast("string")), F.concat(F.lit("b"), F.col("id").cast("string")), F.concat(F.lit("c"), F.floor(F.col("id") / 2).cast("string")), F.lit("all")).alias("k"))
    began = time.perf_counter()
    pairs, members = duplicates.duplicates(df.where("id < 2000 or id % 2 = 0"), "id", F.array_remove("k", "all"))
    assert pairs.count() == 0 and members.count() == 11_000
    assert time.perf_counter() - began < 60
    assert {tuple(r) for r in duplicates.classes(spark.createDataFrame([(2, ["a", "b"]), (1, ["b", "a", None]), (3, []), (None, ["a"]), (4, ["a"])], "id long, k array<string>"), "id", F.col("k")).collect()} == {(2, 1), (1, 1), (4, 4)}


def test_rows_are_dealt_to_more_tasks_as_they_grow(spark):
    """a task's rows grew with the table, however many tasks there were to deal them to."""
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    assert spread(spark.range(1000), "id", most=1000).rdd.getNumPartitions() == least
    assert spread(spark.range(1000), "id", most=10).rdd.getNumPartitions() == 100
    assert spread(spark.range(0), "id").count() == 0
    for name in ("j06_bill_parts", "j06_reading_quality"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_lines_are_dealt_out_by_their_number(spark, monkeypatch):
    """the tasks that sort and group lines grow with the lines; adaptive execution, which goes by bytes, does not join them again."""
    import re

    from tallyloom.plans import joins, lookups, registry, views

    for module in (joins, lookups, views):
        monkeypatch.setattr(module, "DEALT", 50)
    sf = "/root/testdata/sf0.001"
    n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 50)
    for name, key in (("e07_continuations", "l_suppkey"), ("n_vote_page", "l_orderkey"), ("n_government_support", "member")):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"hashpartitioning\({key}#\d+L?[^)]*, {n}\), REPARTITION_BY_NUM", plan), name


def test_facts_are_dealt_out_by_their_number(spark, monkeypatch):
    """a task that sums facts up held as many as bytes told, and wrote a file for each part; a first load was summed twice, and changes once more than they must."""
    from tallyloom.operators import read_models as M
    from tallyloom.session import scratch_folder
    from tallyloom.sources import versions

    model = M.Model(("k",), lambda: {"n": M.count("v"), "kinds": M.distinct("v"), "low": M.least("v", "long")})
    monkeypatch.setattr(M, "DEALT", 100)
    at = scratch_folder(spark, "dealt")
    told = lambda rows: [M.fact(rows, {"k": "k"}, "v", "v", F.col("sign"))]
    first = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"), F.lit(1).alias("sign"))  # one busy key
    built = M.changed(model.keys, "m", told(first))(versions.current(spark, at))["m"]
    assert built.rows._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    tasks = built.rows.rdd.glom().map(lambda rows: (len(rows), len({r.part for r in rows}))).collect()
    assert len(tasks) == 64 and max(n for n, _ in tasks) < 1500 and max(parts for _, parts in tasks) == 1
    assert M.refresh(spark, at, "a", model, "m", told(first)) == "published"
    assert len(versions.current(spark, at).read(spark, "m").inputFiles()) <= 64
    since = first.where("v = 0").withColumn("sign", F.lit(-1)).unionByName(spark.createDataFrame([(1, 9999, 1), (4500, None, 1)], "k long, v long, sign int"))
    assert M.refresh(spark, at, "b", model, "m", told(since), n=3) == "published"
    seen = {r.k: (r.n, r.kinds, r.low) for r in M.rows(versions.current(spark, at).read(spark, "m"), model).collect()}
    assert seen == {k: (1, 1, k) for k in range(4000, 5000)} | {1: (4000, 4000, 1), 4500: (2, 1, 4500)}


def test_turns_are_sorted_once_and_looked_up_by_blocks(spark, monkeypatch):
    """the sort of an owner's turns was done three times, and a turn whose last period is over met all periods of its owner."""
    import datetime as dt

    monkeypatch.setattr(sweep, "RUN", 2)
    rng, on = random.Random(7), lambda n: dt.date(2000, 1, 1) + dt.timedelta(days=n)
    rows = [(o, i, on(s), None if rng.random() < 0.02 else on(s + rng.choice([-2, 0, 1, 5, 40, 400]))) for i in range(300) for o, s in [(rng.choice(["a", "a", "b", None]), rng.randint(0, 500))]]
    rows += [("c", 1000, on(0), on(900)), *[("c", 1001 + i, on(3 * i), on(3 * i)) for i in range(1, 290)]]  # one goes on under many short ones
    got = sweep.winners(spark.createDataFrame(rows, "o string, id long, s date, e date"), "o", "s", "e", "id")
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    last, want = on(10**6), set()
    for o in ("a", "b", "c", None):
        mine = [(s, i, e or last) for x, i, s, e in rows if x == o]
        turns = sorted({s for s, _, _ in mine} | {e + dt.timedelta(1) for _, _, e in mine})
        for d, after in zip(turns, turns[1:]):
            if held := [p for p in mine if p[0] <= d <= p[2]]:
                want.add((o, d, None if after > last else after - dt.timedelta(1), max(held)[1]))
    seen = got.select("o", "from", F.when(F.year("to") < 4000, F.col("to")).alias("to"), "id").collect()
    assert len(seen) == len(want) and {tuple(r) for r in seen} == want


def test_chains_contract_in_few_rounds(spark, monkeypatch):
    """F32: a round went one link on, so that a chain of 2000 took 11."""
    from tallyloom.operators import entities

    names, real = [], entities.materialise
    monkeypatch.setattr(entities, "materialise", lambda df, name: (names.append(name), real(df, name))[1])
    ids = list(range(2000))
    random.Random(5).shuffle(ids)
    links = [*zip(ids, ids[1:]), (3, 3), *zip(ids[1:50], ids)]
    assert {r.id: r.component for r in entities.connected(spark.createDataFrame(links, "a long, b long")).collect()} == dict.fromkeys(ids, 0)
    assert names.count("level") < 10


def test_the_pattern_of_authors_goes_over_a_text_once(spark):
    """the pattern of authors went over each text three times; every line of every page was folded twice in search of headings; all braces were filled, in the text or not."""
    plan = registry.queries()["j10_report_authors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(deputat|senator)") == 1 and plan.count(steps.ANNEX) == 1
    assert "{grp}" in plan and "{land}" not in plan


def test_authors_and_readings_of_odd_texts(spark):
    """what the pattern over single texts gave: a party cut short before a capital, more words than a name has, names within words, white space of all kinds."""
    texts = {
        None: [], " \t\n ": [], "Ion POP deputat PŞD Ana, senator USR": [("Ion POP", "deputy", "P"), ("ŞD Ana", "senator", "USR")],
        "Autori:\tIon\r\n\x0bPOP  –  deputat\fPSD, Ana-Maria  O’HARA,senator neafiliat (fost \n deputat  X)": [("Ion POP", "deputy", "PSD"), ("Ana-Maria O’HARA", "senator", "neafiliat (fost deputat X)")],
        "AMENDAMENTE ADMISE Unu DOI TREI Patru Cinci Șase ȘAPTE, deputat A1": [("DOI TREI Patru Cinci Șase ȘAPTE", "deputy", "A")],
        "abCde Fgh, senator minorități și Doamna deputat Zoe P. - deputat DEAL": [("Cde Fgh", "senator", "minorități"), ("Zoe P.", "deputy", "DEAL")],
        "Domnul Ion, deputat X; Io N deputat Y; Ion Vdeputat PSD": [("Ion V", "deputy", "PSD")],
    }
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", steps.authors(F.col("t")).alias("a")).collect()
    assert {r.t: [tuple(a) for a in r.a] for r in got} == texts
    pages = [
        (1, 1, "Text obișnuit " * 20), (1, 2, "x\r\n \tÂmendămentele\n AMENDAMENTE \n  Anexa nr. 2:  ÃMENDAMENTUL \t ADMISĂ\r\n" + "da " * 30), (1, 3, "amendamente respinse\n(Amendamente respinse)\n" + "da " * 30),
        (2, 1, " \n b1c x~ 1b c1 `a`{ d2e3f\t12\x0b"), (2, 2, None), (3, 1, "a " * 50), (3, 2, "\f"),
    ]
    read = {r.report_id: tuple(r)[1:] for r in steps.report_readings(spark.createDataFrame(pages, "report_id int, page int, text string")).collect()}
    assert read == {1: (3, 0.0, "clean", 2, None), 2: (2, 57.1, "none", None, None), 3: (2, 0.0, "none", None, None)}
