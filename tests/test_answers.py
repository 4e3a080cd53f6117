from pyspark.sql import functions as F

from ledgerline.operators import answers as A


def test_empty_flag(spark):
    none = spark.createDataFrame([], "a long")
    all_null = spark.createDataFrame([(None, None)], "a long, b string")
    part_null = spark.createDataFrame([(None, "x")], "a long, b string")
    assert A.empty_flag(none).first()[0] is True
    assert A.empty_flag(all_null).first()[0] is True
    assert A.empty_flag(part_null).first()[0] is False


def test_route_split(spark):
    df = spark.createDataFrame([(1, "sql"), (2, "rag"), (3, "clarify"), (4, "other"), (5, None)],
                               "id int, route string")
    got = {r["id"]: r["error"] for r in A.route_split(df).collect()}
    assert got == {1: None, 2: None, 3: None, 4: A.ERR_ROUTE, 5: A.ERR_ROUTE}


def test_answer_text(spark):
    df = spark.createDataFrame([
        (1, 0, 5, 123456.5, None, None), (2, 1, None, None, None, None), (3, 1, 7, 1234567.891, "2026-06-01", "2026-06-30"),
        (4, 3, 1, 1.0, None, None)],
        "k int, n int, units long, revenue_pkr double, s string, e string")
    got = {r["k"]: r["answer"] for r in A.answer_text(df, "k", ["revenue_pkr"], "s", "e", "n").collect()}
    assert got[1] == A.NO_RECORDS
    assert got[2] == A.NO_RECORDS
    assert got[3] == "Period: 2026-06-01 to 2026-06-30\n\nUnits: 7\n\nRevenue pkr: 1,234,567.89"
    assert got[4] == "Found 3 results. See the table below."


def test_cost_note(spark):
    df = spark.createDataFrame([(1, 250.0)], "k int, estimated_food_cost_pkr double")
    (r,) = A.answer_text(df, "k", ["estimated_food_cost_pkr"]).collect()
    assert r["answer"] == "Estimated food cost pkr: 250.00\n\n" + A.COST_NOTE


def test_resolve_names(spark):
    cat = spark.createDataFrame([("Chicken Biryani",), ("Beef Biryani",), ("Chicken Tikka",), ("Tea",)], "name string")
    req = spark.createDataFrame([(1, "chicken biryani"), (2, "biryani"), (3, "Chiken Tikka"), (4, "pizza"),
                                 (5, "tea")], "request_id int, name string")
    got = {r["request_id"]: (r["status"], r["resolved_name"], r["n_choices"])
           for r in A.resolve_names(req, cat).collect()}
    assert got[1] == ("resolved", "Chicken Biryani", 1)
    assert got[2] == ("ambiguous", None, 2)
    assert got[3] == ("resolved", "Chicken Tikka", 1)
    assert got[4] == ("unknown", None, 0)
    assert got[5] == ("resolved", "Tea", 1)
    choices = {r["candidate"] for r in A.name_choices(req, cat).collect() if r["request_id"] == 2}
    assert choices == {"Beef Biryani", "Chicken Biryani"}


def test_candidates_against_brute_force(spark):
    """5,000 names: the piece and word joins find what comparing every pair would."""
    import random
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(300)]
    names = sorted({" ".join(r.choice(words) for _ in range(r.randint(1, 3))) for _ in range(5600)})[:5000]
    reqs = []
    for i in range(60):
        s = r.choice(names)
        for _ in range(i % 4):
            j = r.randrange(len(s) + 1)
            s = s[:j] + r.choice(["", "x", "B"]) + s[j + r.randint(0, 1):]
        reqs.append((i, s))
    reqs += [(100, "a"), (101, "ab"), (102, ""), (103, words[0]), (104, words[0].upper() + " " + words[1])]
    cat = spark.createDataFrame([(n,) for n in names], "name string")
    req = spark.createDataFrame(reqs, "request_id int, name string")
    got = {(x.request_id, x.candidate, x.match_level) for x in A.catalog_candidates(req, cat).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]
    want = set()
    for k, q in reqs:
        f = q.lower()
        for n in names:
            if f == n:
                want.add((k, n, 1))
            elif f" {f} " in f" {n} ":
                want.add((k, n, 2))
            elif abs(len(f) - len(n)) <= 2 and distance(f, n) <= 2:
                want.add((k, n, 3))
    assert got == want


def test_unavailable_topic(spark):
    df = spark.createDataFrame([(1, "What is our NET   profit?"), (2, "total sales"), (3, "refunds in May"),
                                (4, "the Vatican in Stockholm"), (5, "customer stock"), (6, "wasteful")],
                               "id int, text string")
    got = {r["id"]: r["topic"] for r in A.unavailable_topic(df).collect()}
    assert got == {1: "net profit", 3: "refund", 5: "stock"}


def test_clarification_split(spark):
    plans = spark.createDataFrame([(1, "SELECT 1", None), (2, None, "Which biryani?"), (3, None, "")],
                                  "id int, sql string, clarification string")
    run, clar = A.clarification_split(plans)
    assert [r["id"] for r in run.collect()] == [1]
    assert {r["id"]: r["clarification"] for r in clar.collect()} == {2: "Which biryani?", 3: A.CLARIFY_DEFAULT}


def test_parse_plans_and_periods(spark):
    """Bad JSON, wrong shapes, nulls, further fields: a row each, never a failed job."""
    import datetime as dt
    rows = [
        ('{"sql": "SELECT 1", "date_spec": {"kind": "year", "year": 2025}}', "SELECT 1", None, "year", dt.date(2025, 1, 1)),
        ('{"sql": null, "clarification": "Which?", "reason": "two", "more": {"a": 1}}', None, None, "none", None),
        ('{"sql": "SELECT 1", "date_spec": {"kind": "fortnight"}}', "SELECT 1", "unsupported date request", "fortnight", None),
        ('{"sql": "SELECT 1"', None, A.ERR_PLAN_JSON, "none", None), ("", None, A.ERR_PLAN_JSON, "none", None),
        ("[1]", None, A.ERR_PLAN_OBJECT, "none", None), ("5", None, A.ERR_PLAN_OBJECT, "none", None), ("null", None, A.ERR_PLAN_OBJECT, "none", None),
        (None, None, A.ERR_PLAN_MISSING, "none", None), ('{"sql": ["a"]}', None, "sql is not text", "none", None),
        ('{"sql": "a", "clarification": 5}', None, "clarification is not text", "none", None),
        ('{"sql": "a", "date_spec": [1]}', None, "date_spec is not an object", "none", None),
        ('{"sql": "a", "date_spec": null}', "a", None, "none", None), ("{}", None, None, "none", None),
    ]
    df = spark.createDataFrame([(i, r[0], dt.date(2026, 1, 1)) for i, r in enumerate(rows)], "id int, plan_json string, reference date")
    rng = spark.createDataFrame([(dt.date(2025, 1, 1), dt.date(2026, 12, 31))], "first_date date, last_date date")
    got = {r["id"]: (r["sql"], r["error"], r["kind"], r["date_start"]) for r in A.plan_periods(df, rng).collect()}
    assert got == {i: r[1:] for i, r in enumerate(rows)}
    assert A.parse_plans(df.where("id = 1")).first()["clarification"] == "Which?"


def test_grouped_results_and_their_answers(spark):
    req = spark.createDataFrame([(i,) for i in range(5)], "rid int")
    res = spark.createDataFrame([(1, "b", 250.0), (2, "d", 1.0), (2, "c", 2.0), (2, "e", None), (3, None, None), (3, None, None)], "rid int, name string, cost_pkr double")
    g = A.grouped_results(req, res, "rid", ["name"])
    assert sorted(map(tuple, g.collect()), key=repr) == [(0, 0, None, None), (1, 1, "b", 250.0), (2, 3, "c", 2.0), (3, 0, None, None), (4, 0, None, None)]
    text = {r["rid"]: r["answer"] for r in A.answer_text(g, "rid", ["cost_pkr"], row_count="row_count").collect()}
    assert text[0] == text[3] == text[4] == A.NO_RECORDS
    assert text[1] == "Name: b\n\nCost pkr: 250.00\n\n" + A.COST_NOTE
    assert text[2] == "Found 3 results. See the table below.\n\n" + A.COST_NOTE
