"""Whole runs: the case of four sources with composite, heterogeneous and differently named attributes, and each mode."""

import json
import warnings
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from attrweave import config
from attrweave.operators import evaluation as E
from attrweave.plans import pipelines
from attrweave.sources import readers as R

INI = """
[algorithm]
clustering_algorithm=AGGLO
record_linkage_method=NONE
number_of_iterations=1
default_apriori_equivalence_ratio=0.2
min_edge_weight=0.1
error_rate_per_value=0.1
similarity_names_weight=0.2
min_common_values_attributes=1
one_value_per_product=no_minweight
use_idf=yes
exclude_same_page_for_generated=yes
[inputs]
category=lamp
excluded_attribute_names=<page title>
[tagging]
max_ratio_occs=1
assign_snippets_one_cluster=yes
min_att_in_cluster=1
min_value_ratio_on_original_attribute=0.1
min_values=1
min_distinct_values_score=0.5
min_mi=0.0001
min_significant_tokens=1
min_distinct_values_generated_mi=1
min_sa_pair=1
min_page_pair=1
"""
MAKERS = ["lumo", "brite", "glowco", "lumo", "brite", "zenit", "zenit", "glowco"]
SHADES = ["linen", "glass", "paper", "steel", "linen", "paper", "glass", "steel"]
BULBS = ["halogen", "led", "filament", "led", "filament", "halogen", "led", "halogen"]
WATTS = [40, 60, 75, 40, 25, 60, 75, 25]
FEET = ["oak", "marble", "brass", "oak", "brass", "marble", "brass", "oak"]
#: site: attribute: value of thing k; what is composite on two sites is split on the two others.
SITES = {
    "one.example": {"maker": MAKERS, "shade": SHADES, "bulb": BULBS, "power": [f"{w} watt" for w in WATTS], "foot": FEET, "lonely": ["here"] * 8},
    "two.example": {"brand": MAKERS, "materials": [f"{s} and {f}" for s, f in zip(SHADES, FEET)], "light": BULBS, "watts": [f"{w} watt" for w in WATTS]},
    "three.example": {"marca": MAKERS, "paralume": SHADES, "lampadina": [f"{b} / {w} watt" for b, w in zip(BULBS, WATTS)], "piede": FEET},
    "four.example": {"brand": MAKERS, "made of": [f"{s}, {f}" for s, f in zip(SHADES, FEET)], "source": BULBS, "consumption": [f"{w} watt" for w in WATTS]},
}
TRUTH = {
    "maker": ["one/maker", "two/brand", "three/marca", "four/brand"],
    "shade": ["one/shade", "two/materials", "three/paralume", "four/made of"],
    "foot": ["one/foot", "two/materials", "three/piede", "four/made of"],
    "bulb": ["one/bulb", "two/light", "three/lampadina", "four/source"],
    "watts": ["one/power", "two/watts", "three/lampadina", "four/consumption"],
}


@pytest.fixture(scope="module")
def lamps(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("lamps")
    for site, attributes in SITES.items():
        (base / site).mkdir()
        urls = [f"http://{site}/{k}" for k in range(8)]
        (base / site / "lamp_spec.json").write_text(json.dumps([{"url": u, "spec": {"<page title>": "no", **{a: str(v[k]) for a, v in attributes.items()}}} for k, u in enumerate(urls)]))
        (base / site / "lamp_linkage.json").write_text(json.dumps({f"lamp{k}": [u] for k, u in enumerate(urls)}))
    (base / "run.ini").write_text(INI)
    return R.specs(spark, str(base)).cache(), R.linkage(spark, str(base)).cache(), config.load(str(base / "run.ini"), common_attributes=1_000)


def found(spark, state):
    """Original attributes by cluster."""
    rows = [(r.cid, "/".join(r.node.split("#-#")[0].split("//")[1:]).replace(".example", "")) for r in state.clusters.collect()]
    groups = {}
    for cid, n in rows:
        groups.setdefault(cid, set()).add(n)
    return {frozenset(g) for g in groups.values()}


def metrics(spark, state):
    nodes = lambda rows: spark.createDataFrame(rows, "node string, cid string")
    return E.schema_level(nodes([(n, str(k)) for k, g in enumerate(found(spark, state)) for n in g]), nodes([(n, t) for t, own in TRUTH.items() for n in own])).first()


MODES = {"classic": 5, "classic-name": 5, "namebl": 1, "domainbl": 2, "namegroup": 5, "comapp": 1}
LOOPS = ["tag-n0", "tag", "tag-x", "tag-b", "tag-xp", "tag-c", "mi-n0", "mi", "tag-ud", "tag-ud0"]


@pytest.fixture(scope="module")
def looped(lamps):
    """The state after the rounds of tag-p, which the modes with a loop share here."""
    claims, links, options = lamps
    return pipelines.tag_loop(pipelines.prepare(claims, links, options), options.but(rounds=4))


def test_composite_attributes_are_found(spark, lamps, looped, monkeypatch):
    claims, links, options = lamps
    assert looped.rounds <= 3
    monkeypatch.setattr(pipelines, "tag_loop", lambda s, o, *more: replace(looped, initial=s.initial))
    state = pipelines.run("tag-p--3", claims, links, options)
    m = metrics(spark, state)
    assert (m.p, m.r) == (1.0, 1.0), found(spark, state)


@pytest.mark.parametrize("mode", LOOPS)
def test_every_mode_with_a_loop(spark, lamps, looped, monkeypatch, mode):
    claims, links, options = lamps
    asked = []
    monkeypatch.setattr(pipelines, "tag_loop", lambda s, o, mi=False, scorer=None: asked.append((mi, scorer, o.linkage_behavior)) or replace(looped, initial=s.initial))
    more = {"scorer": scored} if mode == "tag-c" else {}
    groups = found(spark, pipelines.run(f"{mode}--5", claims, links, options.but(linkage_behavior="ADD"), **more))
    assert all(any(set(own) <= g for g in groups) for own in TRUTH.values()), groups
    assert [x[0] for x in asked] == [mode.startswith("mi")] * len(asked) and all((x[1] is not None) == (mode == "tag-c") for x in asked)
    assert [x[2] for x in asked] == (["ADD", "DELETE"] if mode.startswith("tag-ud") else ["ADD"])


def test_significant_tokens(spark, lamps):
    claims, links, options = lamps
    state = pipelines.prepare(claims, links, options)
    held = [("lamp//one.example//shade", 0), ("lamp//two.example//materials", 0)]
    state.clusters = spark.createDataFrame([(c, n) for n, c in held], "cid long, node string")
    made = pipelines.significant_tokens(state, options.but(min_mi=0.05))
    values = {r.value for r in made.filter("name like 'materials%'").collect()}
    assert values and all(set(v.split()) <= set(SHADES) for v in values)


def test_the_mixed_baseline(spark, lamps):
    claims, links, options = lamps
    state = pipelines.run("mixbl--50", claims, links, options)
    groups = found(spark, state)
    assert {"two/brand", "four/brand"} <= next(g for g in groups if "two/brand" in g)
    assert any({"one/bulb", "two/light", "four/source"} <= g for g in groups)
    # Of a share that no value stays under, names alone are left.
    assert found(spark, pipelines.run("mixbl--1", claims, links, options)) == {frozenset(["two/brand", "four/brand"])}


def scored(pairs):
    """An external matcher: attributes of the same last letter."""
    return pairs.withColumn("weight", F.when(F.expr("right(n1, 1) = right(n2, 1)"), 1.0).otherwise(0.6))


@pytest.mark.parametrize("mode", MODES)
def test_every_mode_runs(spark, lamps, mode):
    claims, links, options = lamps
    more = {"scorer": scored} if mode == "comapp" else {}
    groups = found(spark, pipelines.run(mode, claims, links, options, **more))
    assert len([g for g in groups if len(g) > 1]) >= MODES[mode], groups
    if not more:
        brands = next(g for g in groups if "two/brand" in g)
        assert brands <= set(TRUTH["maker"]) and "four/brand" in brands


def test_published_configurations_can_be_read(tmp_path):
    (tmp_path / "full.ini").write_text("[inputs]\nexcluded_attribute_names=<page title>\ncategory=camera\n[algorithm]\nclustering_algorithm=AGGLO\nrecord_linkage_method=NONE\nnumber_of_iterations=1\nmin_edge_weight=0.5\nexclude_same_page_for_generated=yes\n[tagging]\nassign_snippets_one_cluster=no\nmax_ratio_occs = 0.1\nattributes_to_tag=ALL_ATTRIBUTES\n[simulation]\nsource_removal_rule=KEEP_MORE_LINKAGE\nnumber_sources_keep=8\nlinkage_removal_rule=KEEP_SMALL_CLUSTERS\npercentage_linkage_kept=0.33\n[experiments]\nsource_size=no\n")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        o = config.load(str(tmp_path / "full.ini"))
    assert [str(w.message) for w in said] == ["option clustering_algorithm has no effect", "option source_size has no effect"]
    assert (o.category, o.excluded_names, o.record_linkage, o.iterations, o.min_edge_weight, o.pages_of_virtual) == ("camera", ("<page title>",), "NONE", 1, 0.5, False)
    assert (o.one_cluster, o.dictionary_rarity, o.to_tag, o.source_rule, o.sources_kept, o.linkage_rule, o.linkage_kept) == (False, 0.1, "ALL_ATTRIBUTES", "MORE", 8, "KEEP_SMALL", 0.33)
    d = config.Options()
    assert (d.error_rate, d.apriori, d.min_edge_weight, d.common_ratio, d.min_common_values, d.value_max, d.dictionary_rarity, d.dictionary_least, d.virtual_least, d.one_cluster, d.min_mi, d.min_external) == (0.05, 0.01, 0.2, 0.1, 2, 25, 0.02, 1, 3, True, 1.0, 10)


def test_perturbed_input_comes_back_for_the_report(spark, lamps):
    claims, links, options = lamps
    state = pipelines.prepare(claims, links, options.but(linkage_rule="RANDOM", linkage_kept=0.5, linkage_added=0.25, source_rule="MORE", sources_kept=3))
    assert state.claims.select("site").distinct().count() == 3
    assert state.initial.count() == 24 and state.linkage.select("pid").distinct().count() <= 8
    assert state.linkage.join(state.initial, state.initial.columns, "left_anti").count() > 0
    half = links.filter("url like '%/0' or url like '%/1'")
    state = pipelines.prepare(claims, half, options.but(delete_unlinked=True))
    assert state.claims.select("url").distinct().count() == 8 and pipelines.restored(state).claims.select("url").distinct().count() == 32


def test_linkage_is_found_in_turn_with_matching(spark, lamps):
    claims, links, options = lamps
    known = links.filter("pid not in ('lamp6', 'lamp7')")
    o = options.but(record_linkage="PROB", iterations=2, linkage_apriori=0.2)
    state = pipelines.prepare(claims, known, o)
    state = pipelines.align(state, o)
    rows = state.linkage.join(links.withColumnRenamed("pid", "real"), ["site", "category", "url"])
    # Pages of what wasn't linked have been brought together.
    assert rows.filter("real in ('lamp6', 'lamp7')").groupBy("pid").agg(F.count("*").alias("n"), F.countDistinct("real").alias("k")).filter("n > 1").count() > 0
