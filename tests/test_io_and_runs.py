import json

import pytest
from pyspark.sql import functions as F

from attrweave import config
from attrweave.operators import simulation as S
from attrweave.plans import pipelines
from attrweave.sources import readers as R
from attrweave.sources import writers as W
from attrweave.streaming import intake


def dataset(folder):
    """Four sources that describe the same eight things, one of them with a composite attribute."""
    colours, sizes = ["red", "blue", "green", "black"], ["12 inch", "15 inch", "19 inch", "27 inch"]
    names = {"a.com": ("Color", "Screen Size"), "b.com": ("colour", "display size"), "c.com": ("color", "size"), "d.com": ("paint", "diagonal")}
    for site, (c, s) in names.items():
        (folder / site).mkdir(parents=True)
        pages, links = [], {}
        for k in range(8):
            url = f"https://www.{site}//p/{k}#x"
            pages.append({"spec": {c: colours[k % 4], f" {s}: ": sizes[(k // 2) % 4], "<page title>": f"thing {k}"}, "url": url})
            links[f"p{k}"] = [url]
        (folder / site / "tv_spec.json").write_text(json.dumps(pages))
        (folder / site / "tv_linkage.json").write_text(json.dumps(links))
    (folder / "sources_by_linkage.txt").write_text("a.com__tv\nb.com__tv\n")


@pytest.fixture
def data(spark, tmp_path):
    dataset(tmp_path / "in")
    claims = R.specs(spark, str(tmp_path / "in")).filter("name <> '<page title>'")
    return claims, R.linkage(spark, str(tmp_path / "in")), tmp_path


def test_readers(spark, data):
    claims, links, path = data
    row = claims.filter("site = 'a.com' and url like '%/0'").orderBy("name").collect()
    assert [(r.category, r.url, r.name, r.value) for r in row] == [("tv", "http://a.com/p/0", "color", "red"), ("tv", "http://a.com/p/0", "screen size", "12 inch")]
    assert links.count() == 32 and links.filter("pid = 'p0'").count() == 4
    assert [(r.place, r.site) for r in R.source_order(spark, str(path / "in/sources_by_linkage.txt")).collect()] == [(0, "a.com"), (1, "b.com")]
    assert R.spec_files(spark, str(path / "in")) == 4
    (path / "in/a.com/tv_linkage_x.json").write_text('{"p": ["http://a"], "p": ["http://b"]}')
    with pytest.raises(ValueError, match="twice"):
        R.linkage(spark, str(path / "in"), suffix="_x").collect()
    (path / "g.json").write_text('{"p1": {"tv": ["http://a/1", "http://b/2"]}}')
    assert R.global_linkage(spark, str(path / "g.json")).count() == 2
    (path / "k.json").write_text('{"p1": {"size__0": ["a.com#-#http://a.com/p/1/size=3", "b.com/x/size=4"]}}')
    assert {(r.site, r.url, r.name, r.value) for r in R.ikgpp(spark, str(path / "k.json")).collect()} == {("a.com", "http://a.com/p/1", "size", "3"), ("b.com", "b.com/x", "size", "4")}


def test_runs_find_the_attributes(data):
    claims, links, _ = data
    want = {frozenset(f"tv//{s}//{n}" for s, n in zip(("a.com", "b.com", "c.com", "d.com"), names)) for names in (("color", "colour", "color", "paint"), ("screen size", "display size", "size", "diagonal"))}
    for mode in ("classic", "tag-p--5"):
        state = pipelines.run(mode, claims, links, config.Options(common_attributes=100))
        groups = {}
        for r in state.clusters.collect():
            groups.setdefault(r.cid, set()).add(r.node)
        assert {frozenset(g) for g in groups.values()} == want, mode
    assert pipelines.run("namebl", claims, links).clusters.count() == 2
    with pytest.raises(ValueError):
        pipelines.run("comapp", claims, links)


def test_a_run_that_may_not_end_is_an_error(data):
    claims, links, _ = data
    with pytest.raises(pipelines.NotConverged):
        pipelines.run("tag-p--1", claims, links, config.Options(common_attributes=100))


def test_reports(spark, data):
    claims, links, path = data
    clustered = spark.createDataFrame([(0, "a.com", "tv", "color"), (0, "b.com", "tv", "colour")], "cid long, site string, category string, name string")
    detail = {r.full_name: r for r in W.cluster_detail(clustered, claims, links).collect()}
    assert detail["a.com__tv/color"].cluster_id == "0" and detail["a.com__tv/color"].cluster_size == 2 and detail["a.com__tv/color"].Top1 == "black#2" and detail["a.com__tv/color"].LINKED_PAGES == 8
    assert detail["c.com__tv/size"].cluster_id.startswith("ISOLATED_")
    graph = W.instance_graph(claims, links, clustered, spark.createDataFrame([(0, "color")], "cid long, label string"))
    assert {r.target for r in graph.collect()} == {"color__0"} and graph.count() == 8
    W.specs(claims, str(path / "out"))
    assert spark.read.json(str(path / "out")).count() == 32
    tables = W.relational(claims, links.unionByName(spark.createDataFrame([("px", "a.com", "tv", "http://gone")], links.schema)))
    assert tables["page"].count() == 32 and tables["missing"].count() == 1
    W.csv(detail and W.cluster_detail(clustered, claims, links), str(path / "csv"), ["cluster_id", "extra"])
    assert R.csv(spark, str(path / "csv")).columns[:2] == ["cluster_id", "extra"]
    assert W.snapshot(claims, str(path / "snap")).count() == W.snapshot(claims.limit(0), str(path / "snap")).count() == 64


def test_simulation(data):
    claims, links, _ = data
    assert S.keep_sources(claims, links, 2, "RANDOM", ["d.com"]).select("site").distinct().count() == 2
    assert S.remove_linkage(links, 0.5).count() == 16
    wrong = S.add_errors(links, claims, 0.25)
    assert links.count() < wrong.count() <= links.count() * 1.25
    assert S.coverage_order(links, "site", "pid") == [("a.com", 8)]
    assert S.stratified(links, [F.col("site")], 4, "url").count() == 8


def test_options(tmp_path):
    (tmp_path / "o.ini").write_text("[match]\nmin_edge_weight = 0.3\nidf = no\nmasters = a.com, b.com\n")
    o = config.load(str(tmp_path / "o.ini"), rounds=3)
    assert (o.min_edge_weight, o.idf, o.masters, o.rounds) == (0.3, False, ("a.com", "b.com"), 3)
    (tmp_path / "bad.ini").write_text("[x]\nnothing = 1\n")
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "bad.ini"))


def test_intake_stream(spark, tmp_path):
    dataset(tmp_path / "in")
    stream = intake.spec_stream(spark, str(tmp_path / "in"))
    query = stream.writeStream.format("memory").queryName("intake").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.sql("select * from intake where name <> '<page title>'").count() == 64


def test_command_line(spark, tmp_path, capsys):
    from attrweave import cli

    dataset(tmp_path / "in")
    for site in ("a.com", "b.com", "c.com", "d.com"):
        f = tmp_path / "in" / site / "tv_spec.json"
        f.write_text(json.dumps([{**p, "spec": {k: v for k, v in p["spec"].items() if k != "<page title>"}} for p in json.loads(f.read_text())]))
    (tmp_path / "o.ini").write_text("[o]\ncommon_attributes = 100\n")
    cli.main(["run", "classic", str(tmp_path / "in"), str(tmp_path / "out"), "--ini", str(tmp_path / "o.ini")])
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["clusters"] == 2
    names = {"a.com": ("color", "screen size"), "b.com": ("colour", "display size"), "c.com": ("color", "size"), "d.com": ("paint", "diagonal")}
    (tmp_path / "gt.csv").write_text("cluster_id_real,name,source\n" + "".join(f"{k},{n},{s}__tv\n" for s, both in names.items() for k, n in enumerate(both)))
    cli.main(["evaluate", str(tmp_path / "out/cluster_detail"), str(tmp_path / "gt.csv")])
    found = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert (found["p"], found["r"], found["tp"]) == (1.0, 1.0, 12)
