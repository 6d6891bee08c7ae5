import random

from pyspark.sql import functions as F

from litspark.llm import op3_line_dedup as op3
from litspark.llm import op8_mixing as op8

from .helpers import awkward, documents, rows_of, same_as_sql

SF = "/root/testdata/sf0.001"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, lines string, uid long")


def site():
    r = random.Random(1)
    rows = []
    for i in range(60):
        host = ["a.example", "b.example", "A.example:80"][i % 3]
        body = "".join(f"<p>line {r.randint(0, 40)} of the site</p>" for _ in range(r.randint(0, 6)))
        rows.append((i, f"http://{host}/p/{i}?q#x", f"<html><script>var a='<p>x</p>';</script><nav>Home | About</nav>{body}<div> \t footer é </div></html>"))
    rows += [(100, None, "<p>Home | About</p>"), (101, "no url", "<p>Home | About</p>"), (102, "http://a.example/", None), (103, "http://a.example/", ""),
             (None, "http://b.example", "<p>Home | About<br>footer é<br>own"), (5, "http://b.example", "<!-- c\n --><p>same"), (5, "http://b.example", "<!-- c\n --><p>same"),
             (104, "ftp://u:p@c.example:1/x", "plain\n\ntext\nplain"), (105, "http://c.example", "<p>" + "x" * 100_000 + "</p>" + "<p>y</p>" * 2000)]
    return rows


def test_site_lines_are_the_sql(spark):
    for table in (pages(spark, site()).repartition(4), spark.read.parquet(f"{SF}/pages.parquet"), pages(spark, [])):
        got, want = same_as_sql(op3.drop_site_lines(table), op3.ORACLE, pages=table.select("page_id", "url", "html"))
        assert got == want


def test_boilerplate_goes_and_the_rest_stays(spark):
    out = {r.page_id: r for r in op3.drop_site_lines(pages(spark, site())).collect()}
    assert "Home" not in out[0].text and "footer" not in out[0].text and out[0].n_dropped >= 2
    assert out[100].text == out[101].text == "Home | About"
    assert (out[102].n_lines, out[102].text) == (0, "") and out[None].text == "own"
    assert out[104].text == "plain\ntext\nplain" and out[104].host == "c.example"  # below the page support


def test_no_python_in_the_native_operators(spark):
    for df in (op3.drop_site_lines(spark.read.parquet(f"{SF}/pages.parquet")), op8.op8_mixing(spark, SF)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def sources(spark):
    r = random.Random(4)
    rows = [(i, "w " * r.randint(0, 30), r.choice(["en", "de", "fr", None]), r.choice(["src0"] * 6 + ["src1", "src2", "src5", "x9y", "", None]))
            for i in range(400)] + [(1, "again and again", "en", "src0")] * 3 + awkward()
    return documents(spark, [x if len(x) == 4 else (*x[:2], "en", "src1") for x in rows])


def test_mixture_is_the_sql(spark):
    for table in (sources(spark).repartition(3), spark.read.parquet(f"{SF}/documents.parquet"), documents(spark, [])):
        got, want = same_as_sql(op8.mixture(table), op8.ORACLE, documents=table.select("doc_id", "text", "lang", "source"))
        assert got == want


def fill(target, caps, weights):
    """Water filling by repetition: share what is left, take out who is full."""
    left, out, open_ = min(target, sum(caps.values())), {}, set(caps)
    while open_:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if caps[k] * total <= left * weights[k]}
        if not full:
            return out | {k: left * weights[k] // total for k in open_}
        for k in full:
            out[k] = caps[k]
        left -= sum(caps[k] for k in full)
        open_ -= full
    return out


def test_shortages_go_to_siblings_before_ancestors(spark):
    r = random.Random(5)
    leaves = {(f"domain{d}", lang, f"src{s}"): r.randint(1, 1000) for d in range(3) for lang in ("en", "de") for s in range(4) if r.random() < 0.8}
    weights = {"domain": {"domain0": 7, "domain1": 2}, "lang": {"de": 3}, "source": {"src1": 5}}
    df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
    for budget in (0, 1, 500, 2500, 6000, 10**9):
        got = {tuple(x)[:3]: x.share for x in op8.allotments(df, budget, weights, 1).select("domain", "lang", "source", "share").collect()}
        w = lambda level, k: weights[level].get(k, 1)
        cap = lambda p: sum(v for k, v in leaves.items() if k[:len(p)] == p)
        want = {}
        top = fill(budget, {d: cap((d,)) for d in {k[0] for k in leaves}}, {d: w("domain", d) for d in {k[0] for k in leaves}})
        for d, t in top.items():
            langs = {k[1] for k in leaves if k[0] == d}
            for lang, u in fill(t, {x: cap((d, x)) for x in langs}, {x: w("lang", x) for x in langs}).items():
                own = {k[2]: v for k, v in leaves.items() if k[:2] == (d, lang)}
                want |= {(d, lang, s): v for s, v in fill(u, own, {s: w("source", s) for s in own}).items()}
        assert got == want


def test_prefix_within_the_allotment(spark):
    docs = sources(spark)
    rows = op8.written(op8._located(docs), "t")
    plan = {tuple(r)[:3]: r for r in op8.allotments(rows.groupBy(*op8.TREE).agg(F.sum("n_tokens").alias("tokens")),
            (rows.agg(F.sum("n_tokens")).first()[0]) * op8.BUDGET_PERCENT // 100, op8.WEIGHTS, op8.MAX_EPOCHS).collect()}
    used = {tuple(r)[:3]: r for r in op8.mixture(docs).groupBy(*op8.TREE).agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).collect()}
    longest = rows.agg(F.max("n_tokens")).first()[0]
    for k, p in plan.items():
        t = used[k].t if k in used else 0
        assert t <= p.share and (p.share - t < 3 * longest)
    one = op8.mixed(docs, 50)
    assert one.columns == docs.columns and 0 < one.count() < docs.count()
    assert op8.mixed(documents(spark, []), 50).count() == 0
    assert rows_of(op8.mixed(docs, 50)) == rows_of(op8.mixed(docs.repartition(7), 50))
