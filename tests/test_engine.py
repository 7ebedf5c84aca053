"""Clusters, pool, merging, metrics, state and the engine as a whole."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomlog.operators import clusters, extract, match, merge, metrics, pool
from loomlog.plans.pipeline import Pipeline
from loomlog.sources import config, files
from loomlog.sources.store import open_store


def one_by_one(lines, depth, threshold):
    """Sequential insertion into a token trie: the path of each line."""
    tree, out = {}, []
    for line in lines:
        node, path = tree, []
        for token in line.split()[:depth]:
            if token not in node:
                best, score = None, 0.0
                for other in node:
                    s = clusters._similar(token, other, 0.0)
                    if s >= threshold and s > score:
                        best, score = other, s
                token = best if best is not None else token
            path.append(token)
            node = node.setdefault(token, {})
        out.append(path)
    return out


def test_fuzzy_paths_equal_sequential_insertion(spark):
    rng = random.Random(5)
    vocabulary = ["user1", "user2", "user33", "10.0.0.1", "10.0.0.2", "77", "8", "open", "opened", "close", "x", "ab12", "ab13"]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 5))) for _ in range(150)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "seq bigint, cleaned string")
    got = {r.seq: r.path for r in clusters.with_fuzzy_paths(df, 3, 0.75).collect()}
    assert [got[i] for i in range(len(lines))] == one_by_one(lines, 3, 0.75)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.75, 0.8, 0.87, 0.95, 1.0])
def test_similar_tokens_share_a_key(threshold):
    rng = random.Random(6)
    tokens = {"".join(rng.choice("ab1.-") for _ in range(rng.randint(1, 14))) for _ in range(150)} | {"10.0.0.1", "10.0.0.2", "a" * 32, "b" * 32, "2024-01-01", "2024-01-02"}
    for t in list(tokens)[:60]:
        at = rng.randrange(len(t))
        tokens |= {t[:at] + t[at + 1 :], t[:at] + "x" + t[at:], t[:at] + "y" + t[at + 1 :]} - {""}
    keys = {t: set(clusters._keys(t, threshold)) for t in tokens}
    met = 0
    for a in tokens:
        for b in tokens:
            if a < b and clusters._similar(a, b, 0.0) >= threshold:
                met += 1
                assert keys[a] & keys[b], (a, b)
    assert met or threshold >= 0.95


@pytest.mark.parametrize("threshold", [0.4, 0.8, 0.9])
def test_fuzzy_paths_of_many_tokens(spark, threshold):
    rng = random.Random(9)
    stems = ["session", "request", "worker", "thread", "10.0.0.", "", "node-"]
    lines = [" ".join(rng.choice(stems) + str(rng.randrange(40)) for _ in range(rng.randint(1, 3))) for _ in range(200)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "seq bigint, cleaned string")
    got = {r.seq: r.path for r in clusters.with_fuzzy_paths(df, 3, threshold).collect()}
    assert [got[i] for i in range(len(lines))] == one_by_one(lines, 3, threshold)


@pytest.mark.parametrize("threshold", [0.2, 0.6, 0.9])
def test_mergeable_pairs_against_all_pairs(spark, threshold):
    from loomlog.functions.similarity import pattern_similarity, should_merge

    rng = random.Random(17)
    patterns = {" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 12))) for _ in range(60)}
    patterns |= {p.replace("a", "f", 1) for p in patterns} | {p + " z" for p in list(patterns)[:20]}
    long = [f"w{i}" for i in range(24)]
    patterns |= {" ".join(long[:k] + [x] + long[k + 1 :]) for k in (0, 7, 23) for x in "pq"} | {" ".join(long), " ".join(long[:-1]), " ".join(long[1:])}
    t = spark.createDataFrame(list(enumerate(sorted(patterns))), "i bigint, p string")
    every = t.join(t.select(F.col("i").alias("j"), F.col("p").alias("q")), F.col("i") < F.col("j"))
    for edits in (3, 0):
        want = {(r.i, r.j) for r in every.where(should_merge(F.col("p"), F.col("q"), threshold, edits)).collect()}
        assert {(r.i, r.j) for r in merge.mergeable_pairs(t, threshold, edits).collect()} == want and want


def test_clusters_lookup_and_drawing(spark):
    rows = [(0, "a b c"), (1, "a b c"), (2, "a b d"), (3, "a b c"), (4, "q")]
    paths = clusters.with_exact_paths(spark.createDataFrame([(s, t, str(s)) for s, t in rows], "seq bigint, cleaned string, log_id string"), 3)
    found = clusters.clusters(paths, 2)
    assert [(r.path, r.size, r.reached, r.cluster_id) for r in found.collect()] == [(["a", "b", "c"], 3, 1, "clus_0000")]
    assert {r.seq: r.cluster_id for r in clusters.lookup(paths, found).collect()} == {0: "clus_0000", 1: "clus_0000", 2: None, 3: "clus_0000", 4: None}
    drawn = [r.line for r in clusters.drawn(paths, found).collect()]
    assert drawn[0] == "<ROOT>" and drawn[1].endswith("├── a") and drawn[3].endswith("├── c [clus_0000, 3 logs]") and drawn[-1].endswith("└── q")
    empty = clusters.clusters(paths.limit(0), 2)
    assert clusters.tree_stats(paths.limit(0), empty).first().avg_cluster_size == 0.0


def test_merge_batch(spark):
    base = "a b c d e f g h i j k l m n {} end"
    rows = [(0, base.format("x1"), 5, 0.92), (1, "something else entirely", 1, 0.9), (2, base.format("x2"), 2, 0.95), (3, base.format("x3"), 1, 0.99)]
    t = spark.createDataFrame(rows, "i bigint, p string, count bigint, confidence double")
    got = {r.i: r for r in merge.merged(t, merge.mergeable_pairs(t, 0.9)).collect()}
    assert set(got) == {0, 1} and got[0].p == base.format("<*>") and got[0]["count"] == 8
    assert got[0].confidence == pytest.approx(0.92 * 0.95 * 0.95) and got[1].merges == 0
    assert merge.auto_merge(t).count() == 4 and merge.auto_merge(t, above=3).count() == 2


@pytest.mark.parametrize(
    ("pred", "truth", "expected"),
    [
        (["t1", "t1", "t2", "t2", "t3"], ["g1", "g1", "g2", "g2", "g3"], (0.0, 1.0, 1.0, 1.0, 1.0)),
        (list("aabbbc"), list("aaabbb"), (0.666667, 0.769231, 0.833333, 0.714286, 0.117647)),
        (list("aaaa"), list("bbbb"), (0.0, 1.0, 1.0, 1.0, 0.0)),
        ([], [], (0.0, 0.0, 0.0, 0.0, 0.0)),
    ],
)
def test_metrics(spark, pred, truth, expected):
    labels = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(zip(pred, truth, strict=True))], "seq bigint, pred string, truth string")
    r = metrics.all_metrics(labels).first()
    assert (r.label_accuracy, r.f1, r.precision, r.recall, r.ari) == pytest.approx(expected, abs=1e-6)


def test_metrics_need_equal_lengths(spark):
    one = spark.createDataFrame([(0, "a")], "seq bigint, label string")
    with pytest.raises(ValueError, match="1 predictions"):
        metrics.joined(one, one.limit(0))


LINES = ["2024-01-01 10:00:00 INFO User bob logged in on 12", "2024-01-01 10:00:01 INFO User bob logged in on 13", "", None, "ERROR disk /dev/sda1/x is full", "..........", "ERROR disk /dev/sdb1/y is full"]


def test_parse_and_state(spark, tmp_path):
    engine = Pipeline(spark)
    first = engine.parse_batch(files.list_lines(spark, LINES))
    rows = first.rows.orderBy("seq").collect()
    assert [r.template_id for r in rows] == ["tmpl_0000", "tmpl_0000", "unknown", "unknown", "tmpl_0001", "unknown", "tmpl_0001"]
    assert "12" in rows[0].variables.values() and rows[0].log_level == "INFO" and str(rows[0].timestamp) == "2024-01-01 10:00:00" and rows[2].confidence == 0.0
    engine.save_state(str(tmp_path), first)
    known = engine.load_state(str(tmp_path))
    again = engine.parse_batch(files.list_lines(spark, [LINES[0], "a line never seen before 7"]), known)
    got = again.rows.orderBy("seq").collect()
    assert [(r.template_id, r.cache_hit, r.used_llm) for r in got] == [("tmpl_0000", True, False), ("tmpl_0002", False, True)]
    assert engine.parse("User 5 is here now").confidence == 0.9


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one line here 1\n\n  two lines here 2  \n")
    (tmp_path / "a.csv").write_text('id,log\n1,"says ""hi"", twice 3"\n2,plain line 44\n')
    (tmp_path / "a.json").write_text('[{"log": "json line 5", "x": 1}, {"log": "json line 6"}]')
    read = lambda name: [r.content for r in files.lines(spark, str(tmp_path / name)).orderBy("seq").collect()]
    assert read("a.txt") == ["one line here 1", "two lines here 2"] and read("a.csv") == ['says "hi", twice 3', "plain line 44"] and read("a.json") == ["json line 5", "json line 6"]
    out = Pipeline(spark).parse_file(str(tmp_path / "a.txt"), output=str(tmp_path / "out"))
    assert out.columns == ["original", "template_id", "template", "confidence", "used_llm", "cache_hit", "processing_time_ms"] and spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    rows = spark.createDataFrame([(0, "User 1 in"), (1, "User 2 in")], "seq bigint, cleaned string").withColumn("template_pattern", F.lit("User <*> in"))
    full = pool.pool_rows(pool.mined(rows), pool.last_examples(rows))
    files.write_templates(full, str(tmp_path / "pool"))
    back = files.read_templates(spark, str(tmp_path / "pool")).first()
    assert back.example_logs == ["User 1 in", "User 2 in"] and back.variable_positions == [1] and files.read_templates(spark, str(tmp_path / "none")).count() == 0


def test_external_extractor(spark):
    def connect():
        def ask(texts):
            if any("bad" in t for t in texts):
                raise OSError("no answer")
            return [re.sub(r"\d+", "<*>", t) for t in texts][:2]

        return ask

    good = spark.createDataFrame([("n 1",), ("n 1",), ("n 2",)], "text string").coalesce(1)
    assert {r.text: r.template_pattern for r in extract.external(good, connect).collect()} == {"n 1": "n <*>", "n 2": "n <*>"}
    assert extract.external(spark.createDataFrame([("bad",)], "text string"), connect, retries=1, delay=0.0).first().template_pattern is None


def test_store(spark, tmp_path):
    store = open_store(spark, "table", str(tmp_path))
    entries = spark.createDataFrame([("m1", "t1"), ("m2", "t2")], "log_md5 string, template_id string")
    store.set(entries)
    store.set(spark.createDataFrame([("m1", "t9")], "log_md5 string, template_id string"))
    assert {r.log_md5: r.template_id for r in store.get().collect()} == {"m1": "t9", "m2": "t2"}
    store.delete(entries.where("log_md5 = 'm2'"))
    assert {r.log_md5: r.exists for r in store.exists(entries).collect()} == {"m1": True, "m2": False}
    with pytest.raises(ValueError):
        open_store(spark, "punch cards")
    with pytest.raises(ValueError):
        open_store(spark, "file")


def test_store_opens_again(spark, tmp_path):
    one = lambda k, t: spark.createDataFrame([(k, t)], "log_md5 string, template_id string")
    open_store(spark, "file", str(tmp_path / "s")).set(one("m1", "t1"))
    again = open_store(spark, "file", str(tmp_path / "s"))
    assert again.get().count() == 1
    again.set(one("m2", "t2"))
    (tmp_path / "s" / "v9").mkdir()  # a write that never ended
    assert {r.log_md5 for r in open_store(spark, "file", str(tmp_path / "s")).get().collect()} == {"m1", "m2"}
    memory = open_store(spark, "memory")
    memory.set(one("m3", "t3"))
    assert memory.get().count() == 1 and open_store(spark, "memory").get().count() == 0
    assert open_store(spark, "memory", ttl=-1).exists(one("m3", "t3")).first().exists is False


def test_match_by_pattern(spark):
    t = spark.createDataFrame([("a", "User <*> in"), ("b", "User bob in"), ("c", "<*> in")], "template_id string, template_pattern string")
    logs = spark.createDataFrame([("User bob in",), ("User al in",), ("x in",), ("",), (None,)], "cleaned string")
    assert {r.cleaned: r.template_id for r in match.by_pattern(logs, t).collect()} == {"User bob in": "b", "User al in": "a", "x in": "c", "": None, None: None}


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("DEPTH", "7")
    (tmp_path / "c.yaml").write_text("llm: {model: '${MODEL:m1}'}\nprefix_tree: {max_depth: 4}\nunknown: {a: 1}\n")
    got = config.load(str(tmp_path / "c.yaml"))
    assert got.llm.model == "m1" and got.prefix_tree.max_depth == 4 and config.Config.from_dict(got.to_dict()) == got
    assert config.substituted({"a": ["${DEPTH}", "${NONE:x}", 3]}) == {"a": ["7", "x", 3]}
    with pytest.raises(ValueError):
        config.PrefixTree(fuzzy_threshold=2)


def test_digits_of_other_scripts_are_no_numbers(spark):
    lines = ["١٢ alpha", "٣٤ alpha", "12 alpha", "34 alpha", "1.-2 alpha", "5- alpha", "-- alpha"]
    df = spark.createDataFrame(list(enumerate(lines)), "seq bigint, cleaned string")
    got = {r.seq: r.path for r in clusters.with_fuzzy_paths(df, 2, 0.8).collect()}
    assert [got[i] for i in range(7)] == [["١٢", "alpha"], ["٣٤", "alpha"], ["12", "alpha"], ["12", "alpha"], ["12", "alpha"], ["12", "alpha"], ["--", "alpha"]]


def test_lines_are_in_the_order_of_files(spark, tmp_path):
    (tmp_path / "a b.txt").write_text("first of a\n")
    (tmp_path / "c.txt").write_text("".join(f"line {i} of c\n" for i in range(20_000)))
    (tmp_path / "d.txt").write_text("only of d\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")  # c.txt in several blocks
    try:
        rows = files.text_lines(spark, str(tmp_path)).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.content for r in rows] == ["first of a", *(f"line {i} of c" for i in range(20_000)), "only of d"] and len({r.seq for r in rows}) == 20_002


def test_match_by_pattern_through_constant_words(spark):
    t = spark.createDataFrame([("a", "<*> user <*> in"), ("b", "<*>"), ("c", "x<*> <*>y"), ("d", "<*> user bob in")], "template_id string, template_pattern string")
    logs = spark.createDataFrame([("12 user al in",), ("12 user bob in",), ("xq qy",), ("superuser in",), ("user in",)], "cleaned string")
    assert {r.cleaned: r.template_id for r in match.by_pattern(logs, t).collect()} == {"12 user al in": "a", "12 user bob in": "d", "xq qy": "c", "superuser in": "b", "user in": "b"}


def test_pool_is_merged_and_rows_follow(spark):
    base = "job alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu {} done"
    lines = [base.format(x) for x in ("pq", "pr", "pq", "ps")] + ["nothing else is like this one"]
    small = config.Config(merging=config.Merging(merge_above=2))
    result = Pipeline(spark, small).parse_batch(files.list_lines(spark, lines))
    rows = result.rows.orderBy("seq").collect()
    assert [r.template_id for r in rows] == ["tmpl_0000"] * 4 + ["tmpl_0003"] and rows[1].template_pattern == base.format("<*>") and list(rows[1].variables.values()) == ["pr"]
    assert {r.template_id: r["count"] for r in result.templates.collect()} == {"tmpl_0000": 4, "tmpl_0003": 1}
    assert {r.template_id for r in result.assignments.collect()} == {"tmpl_0000", "tmpl_0003"}
    off = config.Config(merging=config.Merging(merge_above=2, enable_auto_merge=False))
    assert Pipeline(spark, off).parse_batch(files.list_lines(spark, lines)).templates.count() == 4


def test_merge_folds_what_a_pool_holds(spark):
    base = "a b c d e f g h i j k l m n {} end"
    rows = [(k, base.format(x), 1, 0.9, [f"e{k}.{j}" for j in range(6)], [*base.format(x).split()], k) for k, x in enumerate(("x1", "x2"))]
    t = spark.createDataFrame(rows, "i bigint, p string, count bigint, confidence double, example_logs array<string>, static_tokens array<string>, first_seq bigint")
    r = merge.merged(t, merge.mergeable_pairs(t, 0.9)).first()
    assert r.example_logs == [f"e0.{j}" for j in range(6)] + [f"e1.{j}" for j in range(4)] and r.static_tokens == base.replace("{} ", "").split() and r.first_seq == 0 and r.members == [0, 1]


def test_match_modes_and_settings(spark, tmp_path):
    stripped = config.Preprocessing(remove_timestamps=True)
    engine = Pipeline(spark, config.Config(preprocessing=stripped))
    old = [f"2024-01-01 10:00:0{i} INFO worker pool main started task {i}" for i in range(3)]
    first = engine.parse_batch(files.list_lines(spark, old), match_mode="prefix")
    assert [(r.path, r.template_id) for r in first.clusters.collect()] == [(["INFO", "worker", "pool", "main", "started"], "tmpl_0000")]
    engine.save_state(str(tmp_path / "state"), first)
    known = engine.load_state(str(tmp_path / "state"))
    new = files.list_lines(spark, ["2024-01-02 10:00:00 INFO worker pool main started something else", "2024-01-02 10:00:00 INFO another kind of line", "short"])
    ids = lambda r: [x.template_id for x in r.rows.orderBy("seq").collect()]
    assert ids(engine.parse_batch(new, known, match_mode="prefix")) == ["tmpl_0000", "tmpl_0001", "unknown"]
    assert ids(engine.parse_batch(new, known)) == ["tmpl_0001", "tmpl_0002", "unknown"]
    assert ids(engine.parse_batch(files.list_lines(spark, ["INFO worker pool main started task x y"]), known, match_mode="pattern")) == ["tmpl_0000"]
    with pytest.raises(ValueError):
        engine.parse_batch(new, known, match_mode="guess")
    strict = Pipeline(spark, config.Config(parsing=config.Parsing(min_confidence=0.86)))
    assert set(ids(strict.parse_batch(new))) == {"unknown"} and strict.parse("INFO one whole line 7").template_id == "tmpl_0000"
    no_cache = Pipeline(spark, config.Config(parsing=config.Parsing(use_cache=False)))
    lines = files.list_lines(spark, ["INFO one whole line 7"])
    assert no_cache.parse_batch(lines, no_cache.parse_batch(lines)).rows.first().cache_hit is False
    with pytest.raises(ValueError):
        Pipeline(spark, config.Config(llm=config.Extractor(provider="openai")))
    own = Pipeline(spark, prepare=lambda c: F.regexp_replace(c, "secret", "***"))
    assert own.parse("a secret line of text").original == "a secret line of text" and own.parse("a secret line of text").template_pattern == "a *** line of text"
    uuid = "id 1b4e28ba-2fa1-11d2-883f-0016d3cca427 here"
    assert Pipeline(spark, ladder="specific_first").parse(uuid).template_pattern == "id <*> here"


def test_tree_without_repeated_lines(spark):
    lines = files.list_lines(spark, ["same line of text"] * 5 + ["other line of text"])
    engine = Pipeline(spark, config.Config(prefix_tree=config.PrefixTree(min_cluster_size=1, enable_fuzzy_matching=False)))
    paths, found = engine.tree(lines)
    assert paths.count() == 2 and found.count() == 2
    every = Pipeline(spark, config.Config(preprocessing=config.Preprocessing(remove_duplicates=False), prefix_tree=config.PrefixTree(enable_fuzzy_matching=False)))
    assert [r.size for r in every.tree(lines)[1].collect()] == [5]


def test_extractor_awaits_together_and_falls_back_line_by_line(spark):
    def connect():
        import asyncio

        class Client:
            async def one(self, text):
                await asyncio.sleep(0.05)
                if "bad" in text:
                    raise OSError("no answer")
                return text.upper()

        return Client()

    texts = spark.createDataFrame([(f"n {i}",) for i in range(40)] + [("bad",)], "text string").coalesce(1)
    got = {r.text: r.template_pattern for r in extract.external(texts, connect, retries=0).collect()}
    assert got["bad"] is None and got["n 7"] == "N 7" and len(got) == 41


def test_statistics_document(spark):
    engine = Pipeline(spark)
    result = engine.parse_batch(files.list_lines(spark, LINES))
    rows = result.rows
    result.rows = rows
    paths, found = engine.tree(files.list_lines(spark, LINES))
    calls = spark.createDataFrame([(1500, "gpt-3.5-turbo")], "tokens bigint, model string")
    r = engine.statistics(result, paths, found, calls).first()
    assert r.parse.total_logs == 7 and r.parse.failed == 3 and r.pool.total_templates == 2 and r.llm.estimated_cost_usd == 0.0015 and r.tree.total_logs == 3 and r.cache.hits == 0  # two lines are alike when cleaned


def test_ordered_pairs(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (0, 3, 0.95), (0, 2, 0.9)], "i bigint, j bigint, similarity double")
    assert [(r.i, r.j) for r in merge.ordered(pairs).orderBy("place").collect()] == [(0, 3), (0, 2), (1, 2)]


def test_config_goes_to_yaml_and_back(tmp_path):
    own = config.Config(merging=config.Merging(merge_above=7), llm=config.Extractor(model="m"))
    own.to_yaml(str(tmp_path / "deep" / "c.yaml"))
    assert config.load(str(tmp_path / "deep" / "c.yaml")) == own
    config.create_default(str(tmp_path / "new.yaml"))
    assert config.load(str(tmp_path / "new.yaml")) == config.Config()


def test_few_shot_prompt(spark):
    from loomlog.functions import prompts

    text = spark.range(1).select(prompts.extraction(F.lit("x 1"), ["User 5 in"])).first()[0]
    assert "Example 1\nLine: User 5 in\nTemplate: User <*> in" in text and text.endswith("Line: x 1\nTemplate:")


def test_evicted(spark):
    from loomlog.sources.store import evicted

    rows = spark.createDataFrame([(f"m{i}", i) for i in range(5)], "log_md5 string, accessed_at bigint")
    assert {r.log_md5 for r in evicted(rows, 2).collect()} == {"m3", "m4"}


@pytest.mark.parametrize("files_at_once", [1, 10])
def test_drained_streams_lie_in_files(spark, tmp_path, files_at_once):
    from loomlog.plans.catalogue import _drained
    from loomlog.streaming import stream

    for k in range(3):  # a line an hour of three users; the second file says again what the first said at its end
        rows = [(u, f"line {(k * 5 + h) % 12} of {u}", f"2024-01-0{k + 1} 0{h}:00:00") for u in range(3) for h in range(5)]
        spark.createDataFrame(rows, "user_id bigint, content string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    lines = spark.readStream.schema("user_id bigint, content string, ts timestamp").option("maxFilesPerTrigger", files_at_once).parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    sessions = _drained(stream.sessions(lines, "user_id", gap="2 hours", late="30 days"), "complete")
    assert sorted((r.user_id, r.start.day, r["count"]) for r in sessions.collect()) == [(u, d, 5) for u in range(3) for d in (1, 2, 3)]
    fresh = _drained(stream.without_repeats(lines, late="30 days"), "append")
    assert sorted(r.content for r in fresh.collect()) == sorted(f"line {n} of {u}" for u in range(3) for n in range(12))
    assert sessions.inputFiles() and fresh.inputFiles()  # and not in the driver's memory
    nothing = _drained(stream.without_repeats(lines.where("user_id > 9"), late="30 days"), "append")
    assert nothing.columns == lines.columns and nothing.count() == 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
