"""The ten operators against brute force, on one small corpus with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomlog.llm import chat_format, decontaminate, fingerprints, line_dedup, mixing, near_dedup, quality, sharding, substring_dedup, toxicity
from loomlog.llm.common import folded, runs, slices, spread_join
from loomlog.operators.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _d string, size string, shard string"


def lower(s):
    return s.translate({i: i + 32 for i in range(65, 91)})


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "Straße", "the", "The", "of"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base, leak = say(60), say(150), say(30)
    texts = [None, "", " \t\n ", "one", "two words", "a b c", passage, passage, base, base + " end", "Start " + base, say(20000)]
    for i in range(12):
        w = base.split()
        w[rng.randrange(len(w))] = f"edit{i}"
        texts.append(" ".join(w))
    for i in range(30):
        lines = [say(rng.randint(1, 25)) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(1, passage)
        if i % 5 == 0:
            lines.append(leak)
        if i % 7 == 0:
            lines += ["shared line alone", ""]
        texts.append("\n".join(lines))
    texts += texts[20:26]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s10", None]), len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    return rows + [rows[9]], leak, passage


@pytest.fixture(scope="module")
def data():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, data, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(data[0], SCHEMA).repartition(3, "doc_id").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_words_and_hashes():
    texts = ["a bb  ccc", None, "", " x\ty\n", "é ü a b", "bb"]
    for limit in (1, 7, 1 << 20):
        found, hashes = [], {}
        for w in slices(pa.array(texts), limit=limit):
            h = w.hashes()
            for d in range(len(w)):
                own = [bytes(w.buf[a:b]).decode() for a, b in zip(w.starts[w.at[d] : w.at[d + 1]], w.ends[w.at[d] : w.at[d + 1]], strict=True)]
                found.append(own)
                for word, x in zip(own, h[w.at[d] : w.at[d + 1]], strict=True):
                    assert hashes.setdefault(word, x) == x
        assert found == [WORD.findall(t or "") for t in texts] and len(set(hashes.values())) == len(hashes)


def doubled(a, b, n):
    """The Thue-Morse word of a and b of n letters, and its complement: equal under any polynomial hash modulo 2^64 from 2^10 letters on."""
    x = [0]
    while len(x) < n:
        x += [1 - v for v in x]
    return [(a, b)[v] for v in x], [(b, a)[v] for v in x]


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_hashes_do_not_cancel_out(n):
    one, two = doubled("a", "b", n)
    letters = next(iter(slices(pa.array(["".join(one) + " " + "".join(two)])))).hashes()
    assert letters[0] != letters[1]
    words = [next(iter(slices(pa.array([" ".join(w)])))).hashes() for w in (one, two)]
    assert runs(words[0], n)[0] != runs(words[1], n)[0] and len({int(folded(w, np.array([0]), np.array([n]))[0]) for w in words}) == 2
    texts = pa.array(["".join(one), "".join(two), "\n".join(one), "\n".join(two)])
    prints = fingerprints.as_hex(fingerprints.vectors(texts))
    assert prints[0] != prints[1] and prints[2] == prints[3]  # the last two are equal as multisets of lines


def test_long_words_are_hashed_whole():
    rng = random.Random(1)
    words = ["x" * n for n in range(1, 300)] + ["".join(rng.choice("ab") for _ in range(rng.randint(1, 900))) for _ in range(400)]
    words += [w[:i] + "c" + w[i + 1 :] for w in words[-40:] for i in (0, len(w) // 2, len(w) - 1)]
    h = next(iter(slices(pa.array([" ".join(words)])))).hashes()
    seen = {}
    assert all(seen.setdefault(w, x) == x for w, x in zip(words, h, strict=True)) and len(set(h.tolist())) == len(set(words))


def test_hot_keys_meet_their_rows(spark, tmp_path):
    """More keys above the threshold than not, and the other way round: the join is the plain one."""
    rows = spark.createDataFrame([(i % 7 if i < 700 else i, i) for i in range(1000)], "k bigint, v bigint")
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"))
    for total in (1000, 3_000_000, 0):
        got = spread_join(rows, keyed, ["k"], "n", total)
        assert got.columns == ["k", "v", "n", "least"] and Counter(map(tuple, got.collect())) == Counter(map(tuple, rows.join(keyed, "k").select(*got.columns).collect()))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 540)]
    up = {}

    def top(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {v: top(v) for e in edges for v in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# ---------------------------------------------------------------- 1


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_hilbert_curve_is_continuous(dims, bits):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
    place = sharding.axes_to_place(cells, bits)
    assert sorted(place) == list(range(side**dims))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_sharding(docs, data, law):
    out = sharding.assign(sharding.measured(docs), sharding.DIMS, 8, law).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out if r.text_crc32 is not None) == sorted((d[0], len(d[1].encode()) + 1, zlib.crc32(d[1].encode())) for d in data[0] if d[1] is not None)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in by.values()) and len(out) == len(data[0])
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and set(by) == set(range(8))
    order = [r.place for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_sharding_order_against_brute_force(docs, data):
    """Rows in the order of (place, doc_id, ...), cut into eight runs; places from cells that are counted here."""
    small = sharding.measured(docs)
    cuts = sharding.quantiles(small, sharding.DIMS)
    out = sharding.assign(small, sharding.DIMS, 8).collect()
    cell = lambda c, v: max([n for x, n in cuts[c] if v is not None and x <= v], default=0)
    cells = np.array([[cell(c, r[c]) for c in sharding.DIMS] for r in out])
    assert sharding.axes_to_place(cells, sharding.BITS).tolist() == [r.place for r in out]
    order = sorted(out, key=lambda r: (r.place, r.doc_id))
    n = len(order)
    for i, r in enumerate(order):
        assert r.shard == i * 8 // n or order[i - 1].doc_id == r.doc_id or order[min(i + 1, n - 1)].doc_id == r.doc_id
    for c in ("lang", "source"):
        values = sorted(x[2 if c == "lang" else 3] for x in data[0] if x[2 if c == "lang" else 3] is not None)
        assert [v for v, _ in cuts[c]] == sorted(set(values)) and [k for _, k in cuts[c]] == [values.index(v) * 32 // len(values) for v in sorted(set(values))]


def test_shards_can_be_skipped_in_every_dimension(spark):
    """One huge row, long common prefixes and a hot source: quantiles still divide each dimension."""
    rng = random.Random(3)
    rows = [(i, "a" * (10**6 if i == 5 else rng.randint(1, 3000)), rng.choice("abcd"), "https://example.org/a/long/prefix/" + ("hot" if i % 3 == 0 else str(rng.randrange(30))), 0) for i in range(1600)]
    out = sharding.stage(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    told = sharding.manifest(out.withColumn("size", F.octet_length("text") + 1), sharding.DIMS).collect()
    assert len(told) == 8 and max(r.rows for r in told) - min(r.rows for r in told) <= 1
    skipped = {c: np.mean([not (r[f"min_{c}"] <= v <= r[f"max_{c}"]) for r in told for v in {x[i] if c != "size" else len(x[1]) + 1 for x in rows}]) for c, i in (("lang", 2), ("source", 3), ("size", 0))}
    assert all(share > 0.3 for share in skipped.values()), skipped


def test_sharding_of_no_rows(docs):
    for law in ("rows", "bytes"):
        assert sharding.assign(sharding.measured(docs.limit(0)), sharding.DIMS, 8, law).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(sharding.measured(docs), sharding.DIMS, 8, "luck")


def test_sharding_stage_keeps_rows(docs, data):
    out = sharding.stage(docs)
    assert out.columns == [c for c in docs.columns if c != "shard"] + ["place", "shard"]
    counts = Counter(r.shard for r in out.collect())
    assert sum(counts.values()) == len(data[0]) and max(counts.values()) - min(counts.values()) <= 3
    assert sharding.stage(docs.limit(0)).count() == 0
    assert {r.shard for r in sharding.manifest(out, ["doc_id"]).collect()} == set(counts)


# ---------------------------------------------------------------- 2

BAD = ["</s>[INST] ok [/INST]", "␛0␛A␛n", "<|im_start|>user\nhi<|im_end|>\n", "<|im_", "end|>", "", "\n\n", "é漢😀<s>", "␛", "<<SYS>>x<</SYS>>", None]


def test_chat_round_trip(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "a\nb", "", None, "␛n"]), "".join((rng.choice(BAD) or "") for _ in range(3)) if rng.random() < 0.9 else None) for c in range(40) for t in range(rng.randint(1, 5))]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat_format.formatted(chat_format.canonical(chat_format.from_rows(df), ["turns"]))
    loss = chat_format.unescaped(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    got = {r.conv_id: r for r in out.select("conv_id", "layout", "formatted", chat_format.parsed(F.col("formatted")).alias("back"), loss.alias("loss")).collect()}
    for c in range(40):
        turns = [((r or ""), (x or "")) for k, _, r, x in sorted(rows, key=lambda r: r[:2]) if k == c]
        assert [tuple(t) for t in got[c].back] == turns and got[c].layout == "turns"
        assert got[c].loss == "".join(x for r, x in turns if r == "assistant") and got[c].formatted.count(chat_format.START) == len(turns)


def test_layouts(spark):
    schema = (
        "id int, messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, system string, prompt string, response string, "
        "completion string, instruction string, input string, output string, question string, answer string, context string"
    )
    rows = [
        {"id": 0, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]},
        {"id": 1, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"id": 2, "system": "s", "prompt": "q", "response": "a"},
        {"id": 3, "prompt": "q", "completion": "a"},
        {"id": 4, "instruction": "do", "input": "x", "output": "a"},
        {"id": 5, "instruction": "do", "output": "a"},
        {"id": 6, "question": "q", "answer": "a"},
        {"id": 7, "question": "q"},
        {"id": 8},
        {"id": 9, "messages": []},
    ]
    fields = [f.name for f in spark.createDataFrame([], schema).schema]
    df = spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], schema)
    got = {r.id: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat_format.canonical(df, fields[1:]).collect()}
    assert got[0] == ("messages", [("user", "q"), ("assistant", "")]) and got[1] == ("conversations", [("user", "q"), ("assistant", "a")])
    assert got[2] == ("prompt_response", [("system", "s"), ("user", "q"), ("assistant", "a")]) and got[3][0] == "prompt_completion"
    assert got[4] == ("instruction", [("user", "do\n\nx"), ("assistant", "a")]) and got[5] == ("instruction", [("user", "do"), ("assistant", "a")])
    assert got[6][0] == "question_answer" and got[7] == got[8] == got[9] == (None, None)


def test_layouts_of_the_query_come_back(spark):
    turns = lambda *t: [tuple(x) for x in t]
    rows = [
        (1, turns(("user", "q"), ("assistant", ""))), (2, turns(("user", ""), ("assistant", "a"))), (3, turns(("system", "s"), ("user", "q"), ("assistant", "a"))), (4, turns(("system", ""), ("user", "q"), ("assistant", "a"))),
        (5, turns(("user", "q"), ("user", "r"))), (6, turns(("tool", "t"), ("user", "q"))), (7, turns(("human", "q"), ("gpt", "a"))), (8, turns(("", ""))), (9, turns(("assistant", "a"), ("user", "q"))),
    ]
    records = spark.createDataFrame(rows, "conv_id bigint, turns array<struct<role:string,text:string>>")
    laid = chat_format.laid_out(records)
    got = {r.conv_id: (r.layout, [tuple(t) for t in r.turns]) for r in chat_format.canonical(laid, laid.columns[1:]).collect()}
    assert {k: v[1] for k, v in got.items()} == dict(rows)
    assert {k: v[0] for k, v in got.items()} == {1: "prompt_completion", 2: "prompt_response", 3: "prompt_completion", 4: "prompt_response", 5: "conversations", 6: "messages", 7: "turns", 8: "messages", 9: "conversations"}
    assert chat_format.canonical(laid.limit(0), laid.columns[1:]).count() == 0 and chat_format.formatted(records.limit(0)).count() == 0


def test_chat_columns_of_other_names_stay(spark):
    df = spark.createDataFrame([(1, [("user", "q")], "mine", "old", "old", 1, 2)], "conv_id bigint, turns array<struct<role:string,text:string>>, _fingerprint string, layout string, formatted string, segments int, `a.b` int")
    got = chat_format.formatted(chat_format.canonical(df, ["turns"]))
    r = got.first()
    assert sorted(got.columns) == sorted(df.columns) and r["_fingerprint"] == "mine" and r.layout == "turns" and r.formatted == "<|im_start|>user\nq<|im_end|>\n" and r["a.b"] == 2


# ---------------------------------------------------------------- 3


def test_margins_against_brute_force():
    rng = np.random.default_rng(2)
    model = toxicity.Model(0.3, np.arange(6, dtype=np.uint64), rng.normal(size=6), rng.normal(size=(6, 4)))
    sets = [[0, 2, 5], [], [1], [0, 1, 2, 3, 4, 5]]
    got = model.margins(np.repeat(np.arange(4), [len(s) for s in sets]), np.array([t for s in sets for t in s]), 4)
    for s, m in zip(sets, got, strict=True):
        assert m == pytest.approx(0.3 + sum(model.weights[i] for i in s) + sum(model.factors[i] @ model.factors[j] for i in s for j in s if i < j))


def test_machine_learns_a_pair():
    """Label 1 only where two terms meet: no additive weights can tell."""
    rng = np.random.default_rng(1)
    x = rng.random((600, 3)) < 0.5
    label = (x[:, 0] ^ x[:, 1] ^ True).astype(float)
    text, term = np.nonzero(x)
    model = toxicity.fit(text, term, label, np.arange(3, dtype=np.uint64), 0.5, shrink=1e-5)
    assert (((model.margins(text, term, 600) > 0) == label).mean()) > 0.95


def test_toxicity(spark, docs):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 60))] + (["Scumbags!" if i % 8 else "scumbag,"] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(bad)))
    all_ = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(all_, toxicity.for_training(all_.select("doc_id", "toxic")))
    got = {r.doc_id: r.score for r in toxicity.score(all_.select("doc_id", "text"), model).collect()}
    held = [(y, got[i]) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 40 and all((s >= 0.5) == (y == 1) for y, s in held)
    labels = all_.select("doc_id", "toxic")
    kept = toxicity.stage(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    none = toxicity.train(docs, labels.limit(0))
    assert all(0 <= r.score < 0.5 for r in toxicity.score(docs.select("doc_id", "text"), none).collect())
    assert toxicity.score(docs.select("doc_id", "text").limit(0), model).count() == 0
    clash = toxicity.score(docs.select("doc_id", "text", F.lit("mine").alias("score"), F.lit(1).alias("_s")), model)
    assert clash.columns == ["doc_id", "_s", "score"] and dict(clash.dtypes)["score"] == "double"
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "scumbag " * 300_000), (None, "scumbag"), (None, "scumbag")], "doc_id bigint, text string")
    scores = [(r.doc_id, r.score) for r in toxicity.score(odd, model).collect()]
    assert len(scores) == 5 and len({s for i, s in scores if i in (1, 2)}) == 1 and all((s > 0.5) == (i not in (1, 2)) for i, s in scores)


# ---------------------------------------------------------------- 4


def test_decontamination(spark, docs, data):
    rows, leak, passage = data
    near = leak.split()
    near[-1] = "changed"
    items = [(1, leak), (2, " ".join(near)), (3, "never seen in any text at all"), (4, None), (5, ""), (6, "one"), (7, passage.upper())]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = Counter((r.doc_id, r.item_id, round(r.similarity, 9)) for r in decontaminate.contamination(docs, bench).collect())
    bags = lambda w: [tuple(w[j : j + 5]) for j in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]
    expected = Counter()
    for i, text, *_ in rows:
        w = WORD.findall(lower(text or ""))
        for k, item in items:
            v = WORD.findall(lower(item or ""))
            own, best = Counter(bags(v)), 0.0
            for s in range(len(w) - len(v) + 1) if v else ():
                c = Counter(bags(w[s : s + len(v)]))
                low = sum((c & own).values())
                best = max(best, low / (sum(c.values()) + sum(own.values()) - low))
            if best >= 0.8:
                expected[(i, k, round(best, 9))] += 1
    assert got == expected and len({k for _, k, _ in expected}) >= 4
    kept = decontaminate.stage(docs, bench)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if r[0] not in {d for d, _, _ in expected}) and kept.columns == docs.columns
    assert decontaminate.contamination(docs, bench.limit(0)).count() == 0 and decontaminate.stage(docs, bench.limit(0)).count() == len(rows)


def test_simhash_misses_nothing_within_the_radius():
    rng = np.random.default_rng(0)
    items = decontaminate.Items([1], [" ".join(f"w{i}" for i in range(40))], 5)
    mine = items.prints[40][0]
    flips = [sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in range(decontaminate.RADIUS + 5) for _ in range(20)]
    prints = np.array([int(mine) ^ f for f in flips], np.uint64)
    found, _ = items.near(40, prints)
    assert set(found.tolist()) == {i for i, f in enumerate(flips) if f.bit_count() <= decontaminate.RADIUS}


def test_block_tables_find_all_within_the_radius():
    """300 items of one length, and half of the windows near one of them, against every pair."""
    rng = np.random.default_rng(1)
    items = decontaminate.Items(list(range(300)), [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(300)], 5)
    of = items.prints[12]
    prints = np.concatenate([rng.integers(0, 1 << 63, 200, dtype=np.uint64), of[:200] ^ np.array([sum(1 << int(b) for b in rng.choice(64, k % 26, replace=False)) for k in range(200)], np.uint64)])
    every = {(w, j) for w, p in enumerate(prints.tolist()) for j, q in enumerate(of.tolist()) if (p ^ q).bit_count() <= decontaminate.RADIUS}
    assert set(zip(*(x.tolist() for x in items.near(12, prints)), strict=True)) == every and len(every) > 150


def test_decontamination_of_a_very_long_text(spark):
    """Windows are fingerprinted in stretches of bounded length: a leak on both sides of a border is found in a text of 60,000 words."""
    rng = random.Random(12)
    leak = [f"l{i}" for i in range(30)]
    words = [rng.choice(leak) if i % 40 == 0 else f"w{rng.randrange(900)}" for i in range(60_000)]
    for at in (0, decontaminate.SPAN - 12, 50_000, 60_000 - 30):
        words[at : at + 30] = leak
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(leak[:20]))], "doc_id bigint, text string")
    got = decontaminate.contamination(docs, spark.createDataFrame([(7, " ".join(leak))], "item_id bigint, text string")).collect()
    assert [(r.doc_id, r.item_id, r.similarity, r["at"]) for r in got] == [(1, 7, 1.0, 0)]


# ---------------------------------------------------------------- 5


def test_mixing(docs, data):
    rows = data[0]
    size = [len(WORD.findall(t or "")) for _, t, *_ in rows]
    sums = Counter()
    for r, n in zip(rows, size, strict=True):
        sums[r[3]] += n
    names = sorted(sums, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, capped = {}, set()
    while True:
        left, open_ = sum(sums.values()) - sum(3 * sums[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        goal = {s: 3.0 * sums[s] if s in capped else weight[s] * left / max(open_, 1) for s in names}
        more = {s for s in names if goal[s] > 3 * sums[s]}
        if not more - capped:
            break
        capped |= more
    out = mixing.copies(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter(zip([r[0] for r in rows], size, strict=True))
    taken = Counter()
    for r in out:
        assert r.source_size == sums[r.source] and r.target == pytest.approx(goal[r.source]) and 0 <= r.copies <= 3
        assert abs(r.copies - r.target / r.source_size) < 1 if r.source_size else r.copies == 0
        taken[r.source] += r.copies * r.size
    largest = {s: max((n for r, n in zip(rows, size, strict=True) if r[3] == s), default=0) for s in names}
    assert all(abs(taken[s] - goal[s]) <= largest[s] + 1e-6 for s in names)
    mixed = mixing.stage(docs)
    assert mixed.columns == docs.columns and mixing.stage(docs.limit(0)).count() == 0
    want = Counter()
    for r in out:
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +want  # row 9 is repeated: its rows share their copies


def test_mixing_shares_copies_among_repeated_rows(spark):
    """Without doc_id, rows alike in source and size are told apart by nothing: they get as many copies as systematic sampling gives them together."""
    rows = [(None, f"w{i % 5} x y", "en", "a", 0) for i in range(50)] + [(i, "one two", "en", "b", 0) for i in range(400)] + [(None, None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    sized = df.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    want = {r.source: r.n for r in mixing.copies(sized).groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    got = Counter(r.source for r in mixing.stage(df).collect())
    per = Counter(r.text for r in mixing.stage(df).where("source = 'a'").collect())
    assert got["a"] == want["a"] > 50 and got["b"] == want["b"] and got[None] == want[None] == 0 and max(per.values()) - min(per.values()) <= 10


# ---------------------------------------------------------------- 6


def test_patience_alignment():
    a = np.array([1, 2, 3, 4, 9, 9, 5])
    assert line_dedup.aligned(a, np.array([7, 2, 3, 8, 9, 5])).tolist() == [1, 2, 4, 5]
    assert line_dedup.aligned(a, np.array([4, 1])).tolist() in ([0], [1])  # crossing lines: one of them
    assert line_dedup.aligned(np.array([9, 9, 1]), np.array([9, 9, 2])).tolist() == [0, 1]
    assert line_dedup.aligned(np.array([0, 1]), np.array([0, 2])).tolist() == [] and line_dedup.aligned(a, a[:0]).tolist() == []


def test_patience_alignment_between_anchors():
    assert line_dedup.aligned([1, 10, 7, 8, 11, 2, 12, 7, 8], [1, 20, 7, 8, 21, 2, 22]).tolist() == [0, 2, 3, 5]
    assert line_dedup.aligned([5, 5, 6, 6, 1], [9, 6, 6, 9, 5]).tolist() == [1, 2]  # no line is unique: the rarest block
    assert line_dedup.aligned([3, 0, 3], [0, 3, 0]).tolist() == [1]  # blank lines never count


def test_alignments_are_common_subsequences():
    rng = random.Random(7)
    for _ in range(300):
        old, new = ([rng.randrange(12) for _ in range(rng.randint(0, 25))] for _ in range(2))
        pairs = line_dedup.alignment(old, new)
        assert all(new[j] == old[i] for j, i in pairs) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:], strict=False))
        assert pairs or not (set(old) & set(new) - {0})
        assert line_dedup.alignment(old, old) == [(k, k) for k in range(len(old))]


def test_line_dedup(spark, docs, data):
    rows = [(1, "alpha\nbeta\n\ngamma\ndelta"), (2, "new\nbeta\ngamma\nother"), (3, "alpha\nbeta\n\ngamma\ndelta"), (4, None), (5, ""), (6, " \n \n"), (7, "solo"), (8, "beta"), (8, "beta")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = line_dedup.applied(df)
    got = sorted((r.doc_id, r.n_lines, r.removed, r.olds) for r in out.collect())
    assert got[:2] == [(1, 4, [], []), (2, 4, [1, 2], [1])] and got[2] == (3, 4, [0, 1, 2, 3], [1, 2]) and got[3:7] == [(4, 0, [], []), (5, 0, [], []), (6, 2, [], []), (7, 1, [], [])]
    assert got[7:] == [(8, 1, [0], [1, 2])] * 2
    left = {r.doc_id: r.t for r in df.join(out, "doc_id").select("doc_id", line_dedup.without(F.col("text"), F.col("removed")).alias("t")).collect()}
    assert left[2] == "new\nother" and left[3] == "" and left[1] == "alpha\nbeta\ngamma\ndelta"
    assert line_dedup.applied(docs).count() == len(data[0]) and line_dedup.applied(df.limit(0)).count() == 0


def test_line_dedup_against_brute_force(spark, monkeypatch):
    """Lines in up to 130 documents, several to one doc_id, none to some: each document against the first two that share a line with it."""
    monkeypatch.setattr(line_dedup, "LINKS", 10)
    rng = random.Random(10)
    lines = [f"line {i}" for i in range(60)]
    texts = ["\n".join(rng.choice(lines) if rng.random() < 0.6 else f"own {i} {j}" for j in range(rng.randint(0, 8))) for i in range(130)]
    texts += ["\n".join(["frequent one", "frequent two", "", f"mine {i}", rng.choice(lines)]) for i in range(70)]
    rows = [(None if i % 11 == 0 else i // 2, t) for i, t in enumerate(texts)] + [(None, None), (77, texts[154]), (None, "frequent two\nfrequent one")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    key = {(r.doc_id, r.text): (-(1 << 63) if r.doc_id is None else r.doc_id, r.t) for r in df.withColumn("t", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    number = {}
    listed = {k: [number.setdefault(x, len(number) + 1) for x in (t or "").split("\n") if x] for (_, t), k in key.items()}
    want = {}
    for k, new in listed.items():
        olds = set()
        for line in set(new):
            olds |= set(sorted(o for o, x in listed.items() if line in x)[:2])
        hits = {o: line_dedup.aligned(listed[o], new).tolist() for o in olds if o < k}
        want[k] = (len(new), sorted({j for h in hits.values() for j in h}), sorted({o[0] for o, h in hits.items() if h and o[0] != -(1 << 63)}))
    got = Counter((r.doc_id, r.n_lines, tuple(r.removed), tuple(r.olds)) for r in line_dedup.applied(df).collect())
    assert got == Counter((d, want[key[d, t]][0], tuple(want[key[d, t]][1]), tuple(want[key[d, t]][2])) for d, t in rows)


def test_line_dedup_of_many_copies(spark):
    """A frequent line links all its documents, each to the first two only."""
    df = spark.createDataFrame([(i, f"x y\nhello there\nown {i}") for i in range(80)], "doc_id bigint, text string")
    pairs = line_dedup.pairs(line_dedup.line_lists(df)).collect()
    assert sorted((r.od, r.nd) for r in pairs) == [(0, i) for i in range(1, 80)] + [(1, i) for i in range(2, 80)]
    assert sorted(r.removed for r in line_dedup.removals(df).collect()) == [[]] + [[0, 1]] * 79


def test_line_dedup_of_frequent_lines_beside_a_rarer_one(spark):
    """A passage in 80 documents goes from all but the first, although each also shares a line with one other document."""
    rows = [(i, f"stray {i}") for i in range(80)] + [(100 + i, f"stray {i}\nx y\nhello there") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.d: r.removed for r in line_dedup.removals(df).collect()}
    assert got == {i: [] for i in range(80)} | {100: [0]} | {i: [0, 1, 2] for i in range(101, 180)}


def test_line_dedup_beyond_the_first_two_holders(spark, tmp_path):
    """The lines removed are those that an alignment with any earlier document removes, as the query returns them."""
    rng = random.Random(4)
    texts = ["b\na", "b\na", "own\na\nb", "a\nb", "x\na\n \nb\ny"]
    texts += ["\n".join(rng.choice(["p", "q", "r", "s", " ", f"own {i}"]) for _ in range(rng.randint(0, 6))) for i in range(80)]
    df = spark.createDataFrame([(None if i == 40 else i, t) for i, t in enumerate(texts)] + [(90, None), (91, "a\nb"), (91, "a\nb")], "doc_id bigint, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    number = {}
    blank = lambda x: 0 if not x.strip() else number.setdefault(x, len(number) + 1)
    listed = sorted({(-1 if r.doc_id is None else r.doc_id, tuple(blank(x) for x in (r.text or "").split("\n") if x)) for r in df.collect()})
    want = {d: sorted({j for _, old in listed[:k] for j in line_dedup.aligned(old, new).tolist()}) for k, (d, new) in enumerate(listed)}
    out = line_dedup.query(spark, str(tmp_path)).collect()
    assert {-1 if r.doc_id is None else r.doc_id: r.removed for r in out} == want and len(out) == df.count()
    assert want[3] == [0, 1]
    few = {-1 if r.doc_id is None else r.doc_id: r.removed for r in line_dedup.applied(df).collect()}
    assert any(len(few[d]) < len(x) for d, x in want.items())  # the first two holders do not remove all of them


@pytest.mark.parametrize("few", [0, 2, 5, 20])
def test_line_dedup_by_kinds_against_brute_force(spark, monkeypatch, few):
    """The same lines go whether documents meet in pairs, by their kinds or both, next to rare lines, blank ones and copies."""
    monkeypatch.setattr(line_dedup, "FEW", few)
    rng = random.Random(20)
    say = lambda i: rng.choice(["p", "q", "r", "p", "q", " ", f"rare {rng.randrange(25)}", f"own {i}"])
    texts = ["\n".join(say(i) for _ in range(rng.randint(0, 9))) for i in range(90)]
    texts += [texts[i] for i in (3, 3, 40)] + ["p\np\np\nrare 3", "rare 3\np\np\np\np"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    number = {}
    blank = lambda x: 0 if not x.strip() else number.setdefault(x, len(number) + 1)
    listed = [[blank(x) for x in t.split("\n") if x] for t in texts]
    by = [{o: set(line_dedup.aligned(listed[o], new).tolist()) for o in range(k)} for k, new in enumerate(listed)]
    got = {r.doc_id: r for r in line_dedup.applied(df, whole=True).collect()}
    assert {d: r.removed for d, r in got.items()} == {k: sorted({j for x in hits.values() for j in x}) for k, hits in enumerate(by)}
    for k, hits in enumerate(by):  # the documents named do align these lines
        assert set(got[k].removed) == {j for o in got[k].olds for j in hits[o]} and all(hits[o] for o in got[k].olds)


def test_line_dedup_of_lines_that_stay_in_many(spark, monkeypatch):
    """A frequent line of which one place stays in every document does not pair off all its holders."""
    met, hits = [], line_dedup._hits
    monkeypatch.setattr(line_dedup, "_hits", lambda lists, found: met.append(found.count()) or hits(lists, found))
    df = spark.createDataFrame([(i, "x" if i < 2 else f"x\nown {i}\nx") for i in range(80)] + [(90, "a\nx\nb\nx\nc")], "doc_id bigint, text string")
    got = {r.d: r.removed for r in line_dedup.removals(df, whole=True).collect()}
    assert got == {0: [], 1: [0], 2: [0]} | {i: [0, 2] for i in range(3, 80)} | {90: [1, 3]} and sum(met) < 200


# ---------------------------------------------------------------- 7


def test_substring_dedup(spark, docs, data):
    def brute(rows, n=20):
        first, words = {}, {}
        for i, t, *_ in rows:
            words[i] = WORD.findall(t or "")
            for s in range(len(words[i]) - n + 1):
                k = tuple(words[i][s : s + n])
                first[k] = min(first.get(k, (i, s)), (i, s))
        out = {}
        for i, w in words.items():
            gone = set()
            for s in range(len(w) - n + 1):
                if first[tuple(w[s : s + n])] < (i, s):
                    gone |= set(range(s, s + n))
            out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
        return out

    rng = random.Random(8)
    tiny = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 120)))) for i in range(40)] + [(90, "x " * 200), (91, "y " * 19 + "x " * 30)]
    for rows, df in ((data[0], docs), (tiny, spark.createDataFrame(tiny, "doc_id bigint, text string"))):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.removed(df).collect()}
        assert got == brute(rows)
    assert substring_dedup.removed(docs.limit(0)).count() == 0
    assert substring_dedup.removed(docs.withColumn("doc_id", F.lit(None).cast("long"))).count() == len(data[0])


def test_substring_dedup_without_doc_ids_and_with_repeated_ones(spark):
    """Texts that only share a doc_id, or have none, lose the words that repeat, and no others."""
    rng = random.Random(13)
    say = lambda n: [f"w{rng.randrange(2000)}" for _ in range(n)]
    block = say(30)
    rows = [(rng.choice([None, 1, 1, 2, i]), " ".join(say(rng.randint(0, 40)) + (block if i % 2 else []) + say(rng.randint(0, 40)))) for i in range(40)]
    rows += rows[:6] + [(None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    hashed = {(r.doc_id, r.text or ""): r.t for r in df.withColumn("t", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    order = sorted(hashed, key=lambda k: (-(1 << 63) if k[0] is None else k[0], hashed[k]))
    seen, want = set(), {}
    for d, t in order:
        w, gone = t.split(), set()
        for s in range(len(w) - 19):
            if tuple(w[s : s + 20]) in seen:
                gone |= set(range(s, s + 20))
            seen.add(tuple(w[s : s + 20]))
        want[d, t] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    got = Counter(tuple(r) for r in substring_dedup.removed(df).collect())
    assert got == Counter((d, *want[d, t or ""]) for d, t in rows)


def test_maximal_repeats(spark):
    a, b = [f"a{i}" for i in range(70)], [f"b{i}" for i in range(30)]
    rows = [(1, " ".join(a)), (2, " ".join(["x", *a[10:60], "y", *b])), (3, " ".join([*b, "z", *a[:25]]))]
    found = substring_dedup.maximal(substring_dedup.repeats(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert sorted((r.d, r.a, r.b, r.sd, r.sa) for r in found.collect()) == [(2, 1, 51, 1, 10), (3, 0, 30, 2, 52), (3, 31, 56, 1, 0)]


# ---------------------------------------------------------------- 8


@pytest.mark.parametrize("parts", [1, 4, 200, 1000])
def test_near_dedup_does_not_depend_on_partitions(spark, parts):
    """Six pairs, a family of 60 and texts alone: one result at any number of partitions."""
    rng = random.Random(21)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, want, base = [], {}, say(90)
    for i in range(6):
        w = say(60)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w, "end"]))]
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i}
    for i in range(60):
        w = list(base)
        w[rng.randrange(90)] = f"e{i}"
        rows.append((100 + i, " ".join(w)))
        want[100 + i] = 100
    for i in range(20):
        rows.append((200 + i, " ".join(say(50))))
        want[200 + i] = 200 + i
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        forest = near_dedup.candidates(near_dedup.signatures(df, 4).select("doc_id", "n", "sig")).collect() if parts > 200 else None
        got = None if parts > 200 else {r.doc_id: r.component_id for r in near_dedup.classes(df, 4, 80).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    if got is None:  # the forest alone: all else is joins by key
        alone = near_dedup.candidates(near_dedup.signatures(df, 4).select("doc_id", "n", "sig")).collect()
        assert sorted(map(tuple, forest)) == sorted(map(tuple, alone)) and len(forest) > 60
    else:
        assert got == want


def test_orders_take_values_of_their_own():
    firsts = near_dedup._TAKES[:, : near_dedup.RUN].ravel().tolist()
    assert sorted(firsts) == list(range(near_dedup.VALUES)) and all(len(set(t)) == near_dedup.DEPTH for t in near_dedup._TAKES.tolist())


@pytest.mark.parametrize("k", [4, 5])
def test_near_dedup_dense_family(spark, k):
    """400 texts at pairwise similarity 0.787 to 0.789; 40 pairs of them share one shingle more: 0.802 to 0.803."""
    base = [f"w{i}" for i in range(100)]
    tails = {i: [f"t{i % 360 if j == 0 else i}x{j}" for j in range(13)] for i in range(400)}
    rows = [(i, " ".join(base + tail)) for i, tail in tails.items()]
    got = {r.doc_id: r.component_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), k, 80).collect()}
    assert got == {i: i % 360 for i in range(400)}


def test_near_dedup_dense_family_against_brute_force(spark):
    """Random edits of one text, many pairs near the threshold; also texts in two rows of one doc_id."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(200):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([3, 4, 5, 6])):
            words[at] = f"e{rng.randrange(400)}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(t.split()[j : j + 4]) for j in range(117)} for _, t in rows]
    label = list(range(200))
    for x in range(200):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both) and label[x] != label[y]:
                lo, hi = sorted((label[x], label[y]))
                label = [lo if c == hi else c for c in label]
    assert 1 < len(set(label)) < 200
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80)
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(label))
    pairs = near_dedup.completed(spark.createDataFrame([(i, 0, i) for i in range(200)], "node long, family long, comp long"), spark.createDataFrame(rows, "doc_id long, text string"), 4, 80)
    alone = {r.node: r.label for r in near_dedup.components(pairs.selectExpr("x as u", "y as v")).collect()}
    assert {i: alone.get(i, i) for i in range(200)} == dict(enumerate(label))


def test_near_dedup(spark, docs, data):
    def sets(t, k):
        w = WORD.findall(lower(t or ""))
        return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    of = {i: sets(t, 4) for i, t, *_ in data[0]}
    up = {i: i for i in of}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in of:
        for j in of:
            if i < j and of[i] and 100 * len(of[i] & of[j]) >= 80 * len(of[i] | of[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    got = near_dedup.classes(docs.select("doc_id", "text"), 4, 80).collect()
    assert len(got) == len(data[0]) and {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(of[i]), top(i)) for i in of}
    kept = near_dedup.stage(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids)) and {0, 1, 2, 3} <= set(ids) and not {7, 12, 13} & set(ids)
    assert near_dedup.classes(docs.limit(0), 4, 80).count() == 0
    lost = near_dedup.classes(docs.withColumn("doc_id", F.lit(None).cast("long")), 4, 80).collect()
    assert len(lost) == len(data[0]) and all(r.component_id is None for r in lost)


def test_parities_never_rule_out_a_link(spark):
    """Sets of 1 to 600 shingles at similarities all over, sizes on both sides of a power of two: no link is dropped, few others stay."""
    rng = np.random.default_rng(3)
    sets, pairs, links = [], [], set()
    for n in (1, 4, 5, 9, 63, 64, 65, 127, 130, 257, 300, 600):
        for share in (0.0, 0.5, 0.75, 0.79, 0.8, 0.81, 0.9, 1.0):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            both = round(n * 2 * share / (1 + share))
            b = np.unique(np.concatenate([a[:both], rng.integers(0, 1 << 63, n - both, dtype=np.uint64)]))[: n if n % 2 else None]
            x, d = len(sets), len(np.setxor1d(a, b))
            assert near_dedup.differing(near_dedup.parities(a), near_dedup.parities(b)) <= d
            sets += [a, b]
            pairs.append((x, x + 1))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 80 * (len(a) + len(b) - common):
                links.add((x, x + 1))
    long, short = rng.integers(0, 1 << 63, 1025, dtype=np.uint64), rng.integers(0, 1 << 63, 1, dtype=np.uint64)
    assert 0 < near_dedup.differing(near_dedup.parities(short), near_dedup.parities(long)) <= 1026
    sig = spark.createDataFrame([(i, len(v), near_dedup.parities(v)) for i, v in enumerate(sets)], "doc_id long, n long, parity binary")
    left = {(r.x, r.y) for r in near_dedup.plausible(spark.createDataFrame(pairs, "x long, y long"), sig, 80).collect()}
    assert len(links) > 30 and links <= left
    assert not left & {(x, y) for x, y in pairs if len(sets[x]) > 60 and not len(np.intersect1d(sets[x], sets[y]))}


def test_marks_are_sure_of_what_is_not_asked_for(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "MARKS", 64)
    rows = spark.createDataFrame([(None if i == 0 else i, f"t{i}") for i in range(5000)], "doc_id long, text string")
    for ids in (set(), {7}, set(range(1, 5000, 5))):
        got = near_dedup.marked(rows, spark.createDataFrame([(i,) for i in [*ids, *ids]], "doc_id long")).collect()
        assert len(got) == 5000 and {r.doc_id for r in got if r.maybe} >= ids
        assert sum(r.maybe for r in got) <= 2 * len(ids) + 5


def test_near_dedup_leaves_its_orders_nowhere_and_moves_few_texts(spark):
    """Of 400 texts, two are alike and the others pass for candidates at most by chance: only the texts of a few are dealt out."""
    from pathlib import Path

    from loomlog.operators.tables import shared_dir

    rng = random.Random(8)
    text = [" ".join(f"w{rng.randrange(3000)}" for _ in range(120)) for _ in range(400)]
    text[9] = text[4] + " end"
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.rglob("rdd-*"))
    assert {r.doc_id for r in near_dedup.classes(docs, 4, 80).where("doc_id <> component_id").collect()} == {9}
    assert set(shared.rglob("rdd-*")) == before
    asked = spark.createDataFrame([(4, 9)], "x long, y long")
    ids = asked.select(F.explode(F.array("x", "y")).alias("doc_id"))
    assert {4, 9} <= {r.doc_id for r in near_dedup._asked(docs, ids).collect()} and near_dedup._asked(docs, ids).count() < 10
    assert [tuple(r) for r in near_dedup.verified(asked, docs, 4, 80).collect()] == [(4, 9)]


# ---------------------------------------------------------------- 9


def test_fingerprints(docs, data):
    rows = sorted(((i, t or "") for i, t, *_ in data[0]), key=lambda r: (-r[0], r[1]))
    want = Counter()
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(t) // 3
        want[(i, len(t), hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest())] += 1
    got = fingerprints.compared(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by = defaultdict(set)
    text = {i: t or "" for i, t in rows}
    for r in got:
        by[text[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.n_chars < 400 or r.near_edited > 0.4
    assert all(len(v) == 1 for v in by.values())
    assert fingerprints.compared(docs.limit(0)).count() == 0 and fingerprints.compared(docs.where("doc_id = 11")).first().near_next == 1.0


def test_fingerprints_of_one_hot_id(spark):
    """Most rows without doc_id, repeated rows and ids: every row meets the one after it, by doc_id and then by hash of the text."""
    rng = random.Random(14)
    rows = [(None if rng.random() < 0.7 else (1 << 62) + rng.randrange(40), rng.choice([None, "", "same"]) if i % 9 == 0 else " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 30)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    order = sorted(((d if d is not None else -(1 << 63), t, x) for d, t, x in df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))), F.coalesce("text", F.lit(""))).collect()), key=lambda r: (-r[0], r[1]))
    want = Counter()
    for (d, _, t), (_, _, after) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        lanes = [fingerprints.vectors(pa.array([x])) for x in (t, edited, after)]
        want[d, len(t), hashlib.sha256(edited.encode()).hexdigest(), *(fingerprints.as_hex(x)[0] for x in lanes[:2]), *(float(fingerprints.likeness(lanes[0], x)[0]) for x in lanes[1:])] += 1
    assert Counter((-(1 << 63) if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in fingerprints.compared(df).collect()) == want


def test_fingerprints_are_homomorphic():
    a, b = "one two three four\n\nfive six\nseven", "x y z\nq"
    lanes = fingerprints.vectors(pa.array([a, b, f"{a}\n{b}", f"{b}\nseven\n\nfive six\none two three four", None, "", "a", "a\n"]))
    row = lambda i: tuple(v[i : i + 1] for v in lanes)
    same = lambda x, y: all((p == q).all() for p, q in zip(x, y, strict=True))
    assert same(fingerprints.add(row(0), row(1)), row(2)) and same(row(2), row(3)) and same(fingerprints.remove(row(2), row(1)), row(0))
    assert same(row(4), row(5)) and not same(row(6), row(7)) and fingerprints.likeness(row(0), row(1))[0] < 0.5


# ---------------------------------------------------------------- 10


def test_quality(spark, docs):
    rng = random.Random(6)
    say = lambda junk: " ".join(f"w{rng.randrange(500)}" + ("$$$" if junk else "") for _ in range(rng.randint(10, 80)))
    rows = [(i, say(i % 5 == 0), "good" if i % 5 else "bad", "p", int(i % 5 != 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, host string, path string, quality int")
    model = quality.train(df, df.select("doc_id", "quality"))
    got = {r.doc_id: r for r in quality.posteriors(quality.evidence(df.drop("quality"), model)).collect()}
    assert all((got[i].score >= 0.5) == bool(y) for i, *_, y in rows) and got[1].host_mean > 0.9 > 0.1 > got[0].host_mean
    odd = quality.shapes(pa.array([None, "", " \n", "A", "AA aa 1 -- x!!", "a a a b"]))
    assert not odd[:3].any() and odd[4, -4:].tolist() == [0, 0.2, 0.4, 0.2] and odd[5, -4] == 0.5
    none = quality.train(docs, df.select("doc_id", "quality").limit(0))
    sited = docs.select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), "text")
    assert quality.posteriors(quality.evidence(sited, none)).count() == docs.count() and quality.posteriors(quality.evidence(sited.limit(0), none)).count() == 0


def test_posteriors_against_brute_force(spark):
    rng = random.Random(15)
    rows = [(rng.choice(["a", "b", "b", "b", None]), rng.choice(["p", "q", None, ""]), rng.gauss(0.5, 2), "mine", 1) for _ in range(300)]
    df = spark.createDataFrame(rows, "host string, path string, evidence double, _p string, score int")
    got = quality.posteriors(df)
    assert got.columns == ["host", "path", "evidence", "_p", "host_mean", "path_mean", "score"]
    p = [1 / (1 + math.exp(-r[2])) for r in rows]
    mean = sum(p) / len(p)

    def strength(groups):
        groups = [g for g in groups.values() if len(g) > 1]
        n, mid = sum(map(len, groups)), lambda g: sum(g) / len(g)
        within = sum(sum((x - mid(g)) ** 2 for x in g) for g in groups) / n
        spread = max((sum(len(g) * (mid(g) - mean) ** 2 for g in groups) - len(groups) * within) / n, 0)
        return min(max(within / max(spread, 1e-9), 1), 1e4)

    hosts, paths = defaultdict(list), defaultdict(list)
    for r, x in zip(rows, p, strict=True):
        hosts[r[0]].append(x), paths[r[:2]].append(x)
    kh, kp = strength(hosts), strength(paths)
    want = []
    for r, x in zip(rows, p, strict=True):
        hm = (sum(hosts[r[0]]) - x + kh * mean) / (len(hosts[r[0]]) - 1 + kh)
        pm = (sum(paths[r[:2]]) - x + kp * hm) / (len(paths[r[:2]]) - 1 + kp)
        logit = r[2] + math.log(pm / (1 - pm)) - math.log(mean / (1 - mean))
        want.append((str(r[0]), str(r[1]), round(r[2], 9), round(hm, 9), round(pm, 9), round(1 / (1 + math.exp(-logit)), 9)))
    assert sorted((str(r.host), str(r.path), *(round(r[c], 9) for c in ("evidence", "host_mean", "path_mean", "score"))) for r in got.collect()) == sorted(want)


def test_sparse_sites_are_shrunk(spark):
    rows = [("big", "a", 3.0)] * 200 + [("low", "a", -3.0)] * 200 + [("one", "a", 3.0), ("two", "b", 3.0), ("two", "b", 3.0)] + [(None, None, 0.0)]
    got = quality.posteriors(spark.createDataFrame(rows, "host string, path string, evidence double")).collect()
    mean = lambda h: [r.host_mean for r in got if r.host == h][0]
    assert len(got) == len(rows) and mean("low") < mean("one") < mean("two") < mean("big") and math.isclose(mean("one"), 0.5, abs_tol=0.05)
