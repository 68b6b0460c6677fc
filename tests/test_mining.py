import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from sieveline import constants as C
from sieveline.operators import mining
from sieveline.plans import cli, queries_mining
from sieveline.sources import registry, store

UNIT = "repo string, ordinal long, id string, name string, file string, comment string, body string, n_lines int"
LONG = "int f(int a)\n{\n    int total = a * 3;\n    total += compute(a, total);\n    return total - offset;\n}"


def units(spark):
    body = "int g%d(int a)\n{\n    return a + %d;\n}"
    rows = [
        ("grow the buffer to hold more", body % (0, 10), 4), ("put one character at the end", body % (1, 11), 4), ("put one character at the end", body % (1, 11), 4), ("do it right now please", "int h(int a) { return a; }", 1),
        ("the same comment on two", body % (4, 14), 4), ("the same comment on two", body % (5, 15), 4), ("", body % (6, 16), 4), ("copied from the benchmark itself", LONG, 6), ("nearly what the benchmark comment says", body % (8, 18), 4),
    ]
    return spark.createDataFrame([("r", i, f"a.c::{i}", f"g{i}", "a.c", c, b, n) for i, (c, b, n) in enumerate(rows)], UNIT)


def test_funnel(spark):
    bench = spark.createDataFrame([("x", "x.c", "Nearly what the benchmark comment says. Done.", LONG)], "name string, file string, comment string, body string")
    rows = {r.ordinal: r for r in mining.mining_funnel(units(spark), bench).collect()}
    assert [rows[i].reason for i in range(9)] == [None, None, "duplicate_code", "too_short", "duplicate_comment", "duplicate_comment", "no_query", "benchmark_code_exact", "benchmark_comment_near"]
    assert [i for i in rows if not rows[i].in_pool] == [2, 7]
    stats = mining.mining_stats(mining.mining_funnel(units(spark), bench)).first()
    assert (stats.functions, stats.with_query, stats.duplicate_code, stats.too_short, stats.duplicate_comment, stats.kept) == (9, 6, 1, 1, 2, 2)


@pytest.mark.parametrize(("text", "reason"), [(LONG, "benchmark_code_exact"), (LONG.replace("offset", "shift"), "benchmark_code_near"), ("int other(void) { return 1; }", None)])
def test_code_guard(spark, text, reason):
    rows, bench = spark.createDataFrame([(1, text)], "a long, x string"), spark.createDataFrame([(LONG,)], "x string")
    assert mining.code_reasons(rows, bench).first().reason == reason


def test_disjoint_repositories(spark):
    schema = "name string, url string, commit string, tag string, license string, paths array<string>"
    bench, training = spark.createDataFrame(C.PINNED, schema), spark.createDataFrame(C.TRAINING, schema)
    mining.check_disjoint_repos(training, bench)
    for name, url in (("own", "HTTPS://github.com/LUA/lua"), ("ZLIB", "https://x/y.git")):
        with pytest.raises(ValueError, match=name):
            mining.check_disjoint_repos(spark.createDataFrame([(name, url)], "name string, url string"), bench)


def test_random_negatives_are_allowed_and_for_all(spark):
    pool = spark.createDataFrame([("r", "train", f"u{i}", f"h{i % 7}") for i in range(60)] + [("r", "val", "v0", "hx")], "repo string, split string, id string, hash string")
    found = mining.random_negatives(pool, pool, arcs_tried=1).collect()
    hashes = {r.id: r.hash for r in pool.collect()}
    assert {r.id for r in found} == {f"u{i}" for i in range(60)} and all(hashes[r.id] != hashes[r.negative] for r in found)
    assert sorted(map(tuple, found)) == sorted(map(tuple, mining.random_negatives(pool, pool, arcs_tried=9).collect()))


def naive_hard_negatives(pairs, pool, depth):
    """By the definition: BM25 within the repository and split, the first `depth` allowed ones, of those the least hash."""
    found = set()
    for repo, split, query_id, own_id, own_hash, tokens in pairs:
        docs = [d for d in pool if d[:2] == (repo, split)]
        mean = sum(len(d[5]) for d in docs) / len(docs)
        scores = []
        for d in docs:
            score = 0.0
            for t in sorted(set(tokens)):
                df = sum(t in x[5] for x in docs)
                if tf := d[5].count(t):
                    score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d[5]) / mean))
            scores.append((-round(score, 9), d[2], d))
        allowed = [d[3] for _, _, d in sorted(scores) if d[3] != own_id and d[4] != own_hash][:depth]
        if allowed:
            found.add((repo, split, query_id, min(allowed, key=lambda x: (hashlib.sha1(f"0/{own_id}/{x}".encode()).hexdigest(), x))))
    return found


@pytest.mark.parametrize("block_rows", [500_000, 40])
def test_hard_negatives_of_every_group(spark, block_rows):
    draw = random.Random(6)
    words = "ring grow slot push index token score rank body head tail swap".split()
    pool, pairs = [], []
    for repo, split, n in (("r", "train", 40), ("r", "val", 25), ("s", "train", 30), ("s", "val", 1), ("t", "train", 3)):
        for i in range(n):
            pool.append((repo, split, i, f"{repo}{split}{i}", f"h{i // 2 if repo == 's' else i}", draw.choices(words, k=draw.randint(0, 9))))
            pairs.append((*pool[-1][:5], draw.choices([*words, "unknown"], k=draw.randint(1, 4))))
    tail = "id string, hash string, tokens array<string>"
    found = mining.hard_negatives(spark.createDataFrame(pairs, f"repo string, split string, query_id long, {tail}"), spark.createDataFrame(pool, f"repo string, split string, ordinal long, {tail}"), depth=4, block_rows=block_rows)
    assert {tuple(r) for r in found.select("repo", "split", "query_id", "negative").collect()} == naive_hard_negatives(pairs, pool, 4)


def test_hard_negatives_leave_no_language_out(spark, sf):
    kept = queries_mining._funnel(spark, sf).where("reason IS NULL").select("ordinal", "repo").collect()
    found = {r.query_id for r in queries_mining.hard_negatives(spark, sf).collect()}
    assert found == {r.ordinal for r in kept} and len({r.repo for r in kept}) == 4


def test_lexical_tokens_are_of_the_whole_body(spark):
    row = spark.createDataFrame([("ring.c::push", "push (ring.c)\nfirst words\nlast words")], "id string, code string").select(mining.lexical_tokens("id", "code")).first()
    assert row[0] == ["ring", "first", "words", "last", "words"]


def test_command_mines_both_modes(spark, tmp_path):
    own, bench = tmp_path / "own", tmp_path / "bench"
    for place, lines in ((own, ["grow the ring to hold more", "push a value onto the stack", "count every slot of the table", "swap the head with the tail"]), (bench, ["nothing that is like the others"])):
        place.mkdir()
        (place / "a.c").write_text("\n".join(f"/* {x} */\nint f{i}(int a)\n{{\n    int {x.split()[-1]}_{i} = a * {i};\n    {x.split()[0]}(a, {i + 3});\n    return {x.split()[-1]}_{i};\n}}\n" for i, x in enumerate(lines)))
    assert cli.main(["mine", "--training", str(own), "--benchmark", str(bench), "--out-dir", str(tmp_path / "out")]) == 0
    pairs = {mode: store.load_pairs(spark, str(tmp_path / f"out/pairs_{mode}.jsonl")).collect() for mode in ("random", "hard")}
    assert len(pairs["hard"]) == 4 and {r.unit_id for r in pairs["hard"]} == {r.unit_id for r in pairs["random"]}
    assert all(r.negative and r.negative != r.code for own in pairs.values() for r in own)


def test_all_languages_have_both_modes(spark, sf):
    rows = queries_mining.mine_all(spark, sf).collect()
    by_mode = {mode: {(r.repo, r.split, r.id): r.negative for r in rows if r.mode == mode} for mode in ("random", "hard")}
    assert by_mode["random"].keys() == by_mode["hard"].keys() and len(rows) == 2 * len(by_mode["hard"]) and None not in by_mode["hard"].values()
    with pytest.raises(ValueError, match="odd"):
        mining.negatives(None, None, "odd")


def test_run_configuration():
    text = "[defaults]\nbatch_size = 8\n[runs.a]\nbatch_size = 4\n[runs.b]\nbogus = 1\n[runs.c]\nnegatives = 'odd'"
    assert registry.run_config(text, "a")["batch_size"] == 4
    with pytest.raises(ValueError, match="bogus"):
        registry.run_config(text, "b")
    with pytest.raises(ValueError, match="odd"):
        registry.run_config(text, "c")
    with pytest.raises(KeyError):
        registry.run_config(text, "d")


def test_model_specs(spark):
    runs = spark.createDataFrame([("r1", "FINISHED", "hard", 1, "/a"), ("r2", "FINISHED", "random", 2, "/b"), ("r3", "RUNNING", "hard", 3, "/c"), ("r4", "FINISHED", "hard", 4, None)], "run_id string, status string, tag string, start_time int, artifact string")
    metrics = spark.createDataFrame([("r1", "final_val_mrr", 1, 0.5), ("r2", "final_val_mrr", 1, 0.9), ("r3", "final_val_mrr", 1, 0.99)], "run_id string, key string, step int, value double")
    assert registry.resolve_model("hub/name", runs, metrics) == "hub/name"
    assert registry.resolve_model("mlflow:best", runs, metrics) == "/b" and registry.resolve_model("mlflow:best-hard", runs, metrics) == "/a" and registry.resolve_model("mlflow:r3", runs, metrics) == "/c"
    for spec in ("mlflow:best-none", "mlflow:r9", "mlflow:r4"):
        with pytest.raises(LookupError):
            registry.resolve_model(spec, runs, metrics)


@pytest.mark.parametrize("cut", [0.0, 0.3, 0.5, 0.6, 1.0])
def test_near_sets_are_the_plain_ones(spark, cut):
    """Sets of all sizes, empty ones, equal ones, and two shingles that all sets have."""
    draw = random.Random(11)
    sets = lambda n: [sorted({1, 2, *(draw.randint(3, 30) for _ in range(draw.randint(0, 12)))}) if draw.random() < 0.9 else [] for _ in range(n)]
    left, right = sets(120), sets(40)
    right += right[:5]
    left += right[:5] + [[99], [1], [1, 2]]
    found = {r.a: r.j for r in mining.near_sets(spark.createDataFrame(list(enumerate(left)), "a long, shingles array<long>"), spark.createDataFrame([(x,) for x in right], "shingles array<long>"), cut).collect()}
    best = {a: max((len(set(x) & set(y)) / len(set(x) | set(y)) for y in right if x and y), default=0.0) for a, x in enumerate(left)}
    assert found == pytest.approx({a: j for a, j in best.items() if j > 0 and j >= cut})


def test_a_shingle_of_all_sets_makes_no_pairs(spark):
    """A thousand sets that share two shingles and have nothing else in common: pairs are made for equal sizes of prefixes only, not for rows times sets."""
    left = spark.range(1_000).select(F.col("id").alias("a"), F.array(F.lit(-1).cast("long"), F.lit(-2).cast("long"), F.col("id"), F.col("id") + 5_000).alias("shingles"))
    right = spark.range(1_000).select(F.array(F.lit(-1).cast("long"), F.lit(-2).cast("long"), F.col("id") + 20_000, F.col("id") + 30_000).alias("shingles"))
    assert mining.near_sets(left, right, 0.6).count() == 0
    assert {round(r.j, 6) for r in mining.near_sets(left, right, 0.3).collect()} == {0.333333}


def test_commands_train_and_use_a_run(spark, tmp_path, capsys):
    """mine, train, query and bench by the trained model; what they say about models that aren't there."""
    own, bench = tmp_path / "own", tmp_path / "bench"
    words = "ring stack table head tail slot queue value index body".split()
    for place, n in ((own, 40), (bench, 3)):
        place.mkdir()
        for k in range(8 if place is own else 1):
            (place / f"f{k}.c").write_text("\n".join(f"/* {words[i % 10]} number {i} of {place.name} file {k} */\nint f{k}_{i}(int a)\n{{\n    int {words[i % 10]}_{i} = a * {i};\n    {words[(i + 3) % 10]}(a, {i + 3}, {k});\n    return {words[i % 10]}_{i};\n}}\n" for i in range(n // (8 if place is own else 1))))
    out, runs = tmp_path / "out", tmp_path / "runs"
    assert cli.main(["mine", "--training", str(own), "--benchmark", str(bench), "--out-dir", str(out)]) == 0
    assert "| own | 40 |" in (out / "stats.md").read_text()
    config = tmp_path / "runs.toml"
    config.write_text("[defaults]\nbatch_size = 8\nlearning_rate = 0.01\neval_every = 2\n[runs.a]\nnegatives = 'random'\n")
    assert cli.main(["train", str(config), "a", "--pairs-dir", str(out), "--tracking-dir", str(runs), "--run-id", "first"]) == 0
    log = registry.RunLog(spark, str(runs))
    assert log.runs().first().status == "FINISHED" and {r.key for r in log.metrics().collect()} == {"train_loss", "learning_rate", "val_mrr", "final_val_mrr"}
    assert cli.main(["query", str(bench), "ring number 0", "--model", "mlflow:best-random", "--tracking-dir", str(runs), "-k", "2"]) == 0
    assert cli.main(["query", str(bench), "x", "--model", "mlflow:best-hard", "--tracking-dir", str(runs)]) == 2 and cli.main(["query", str(bench), "x", "--model", "other"]) == 2
    assert cli.main(["bench", "--repo", str(tmp_path / "none")]) == 2 and cli.main(["bench"]) == 2
    assert cli.main(["ablation", str(tmp_path / "dump"), "hashed-64", "--repo", str(own), "--model", "hashed-8", "--out", str(tmp_path / "ablation.md"), "--resamples", "200"]) == 0
    text = (tmp_path / "ablation.md").read_text()
    assert "hashed-8" in text and "ΔR@10" in text and "| own |" in text
    assert cli.main(["ablation", str(tmp_path / "dump"), "hashed-64", "--out", str(tmp_path / "again.md"), "--resamples", "200"]) == 0 and (tmp_path / "again.md").read_text() == text
    assert cli.main(["train", str(config), "b", "--pairs-dir", str(out)]) == 2
    capsys.readouterr()


def test_leak_audits_move_no_texts(spark):
    """Repeated pairs and units keep a row each; texts are no keys of joins."""
    code = "int f(int a)\nreturn a + 1 ;\nwhile ( a ) { b = c + d ; e = f ( g ) ; }"
    rows = [("u1", "opens the file", "nothing alike", ""), ("u1", "opens the file", "nothing alike", ""), ("u2", "something else", code, ""), ("u3", "something else", "nothing alike", code), ("u4", "opens  THE file", code, code), (None, "opens the file", "x", ""), ("u5", None, "x", None)]
    pairs = spark.createDataFrame(rows, "unit_id string, query string, code string, negative string")
    found = mining.find_leaks(pairs, spark.createDataFrame([(code, "opens the file")], "code string, comment string"))
    want = [("u1", "benchmark_comment_exact")] * 2 + [(u, "benchmark_code_exact") for u in ("u2", "u3", "u4")] + [(None, "benchmark_comment_exact")]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("query" in line or "code" in line for line in joins), joins
