"""Command line: index, query, bench, mine, train and ablation."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from sieveline import constants as C

DEFAULT_MODEL = "hashed-64"


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("sieveline").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _open(args):
    from sieveline.plans.search import SearchIndex

    spark = _session()
    if args.index_dir:
        return SearchIndex.load(spark, args.index_dir)
    return SearchIndex.open(spark, args.repo, f"{args.repo.rstrip('/')}/{C.INDEX_DIRECTORY}", **_model(spark, args.model, args.tracking_dir))


def _model(spark, name: str, tracking_dir: str) -> dict:
    """The options of an index for a model: one of the library, or the artefact of a run, which is a map of the queries' vectors behind the default one. LookupError if there is none."""
    from sieveline.operators import dense, training
    from sieveline.sources import registry

    log = registry.RunLog(spark, tracking_dir)
    found = registry.resolve_model(name, log.runs(), log.metrics())
    if found == name:
        return {"model_name": name, "embedder": dense.named_embedder(name)}
    state = training.load_state(spark, found)
    if state is None:
        raise LookupError(f"the artefact of {name!r} is gone")
    base = dense.named_embedder(DEFAULT_MODEL)
    # The documents' vectors are the default model's: an index of them serves all its runs.
    return {"model_name": DEFAULT_MODEL, "embedder": base, "query_embedder": dense.mapped_embedder(base, state.weights)}


def _index(args) -> int:
    from sieveline.plans.search import SearchIndex

    spark = _session()
    index = SearchIndex.build(spark, args.repo, **_model(spark, args.model, args.tracking_dir))
    out = args.index_dir or f"{args.repo.rstrip('/')}/{C.INDEX_DIRECTORY}"
    index.save(out)
    print(f"indexed {index.units.count()} functions, {index.edges.count()} call edges -> {out}")
    return 0


def _query(args) -> int:
    for r in _open(args).search(args.query, args.k, args.method).collect():
        print(f"{r['rank']:2d}. {r['score']:.4f}  {r['name']}  {r['file']}:{r['start_line']}-{r['end_line']}")
        if args.show:
            print(f"    {r['signature']}")
            if r["comment"]:
                print(f"    // {r['comment'][:160]}")
    return 0


def _bench(args) -> int:
    from sieveline.plans import bench, report
    from sieveline.sources.files import parse_repository

    from sieveline.operators import dense
    from sieveline.sources.scratch import written

    roots = [*(args.repo or []), *(sorted(str(p) for p in Path(args.data_dir).iterdir() if p.is_dir()) if args.data_dir and Path(args.data_dir).is_dir() else [])]
    missing = [r for r in [*roots, *([args.data_dir] if args.data_dir else [])] if not Path(r).is_dir()]
    if missing or not roots:
        print(f"error: {missing[0]} is not a directory" if missing else "error: no repository", file=sys.stderr)
        return 2
    spark, corpora, metrics, parsed = _session(), [], [], {}
    options = _model(spark, args.model, args.tracking_dir)
    for root in roots:
        parsed[Path(root).name] = written(parse_repository(spark, root), "units")
        own, corpus = bench.evaluate_repository(parsed[Path(root).name], Path(root).name, **options)
        metrics += own
        corpora.append(corpus)
    ablation = ""
    if args.ablation_model:
        models = {m: dense.named_embedder(m) for m in dict.fromkeys([args.model, *args.ablation_model])}
        ablation = _ablation_text(bench.ablation_ranks(parsed, models), args.model, C.RESAMPLES, 0)
    text = report.benchmark_report(corpora, metrics, bench.macro(metrics), args.model, ablation)
    Path(args.out).write_text(text)
    print(text)
    return 0


def _mine(args) -> int:
    from pyspark.sql import functions as F

    from sieveline.operators import mining
    from sieveline.plans import report
    from sieveline.sources import store
    from sieveline.sources.files import parse_repository
    from sieveline.sources.scratch import written

    spark = _session()

    def parsed(roots):
        total = None
        for root in roots:
            own = parse_repository(spark, root, Path(root).name).withColumn("n_lines", F.col("end_line") - F.col("start_line") + 1)
            total = own if total is None else total.unionByName(own)
        return written(total, "units")

    training, bench = parsed(args.training), parsed(args.benchmark)
    funnel = written(mining.mining_funnel(training, bench), "funnel")
    kept, pool = funnel.where("reason IS NULL"), funnel.where("in_pool")
    codes = pool.select("repo", F.col("id").alias("negative"), F.col("code").alias("negative_code"))
    from sieveline.functions.text import dense_text

    mined = {}
    for mode in C.NEGATIVE_MODES:
        pairs = kept.join(mining.negatives(kept, pool, mode, args.seed), ["repo", "split", "id"], "left").join(codes, ["repo", "negative"], "left")
        mined[mode] = written(pairs.select("repo", F.col("id").alias("unit_id"), "query", "code", "split", F.coalesce("negative_code", F.lit("")).alias("negative")), "pairs")
        leak = mining.find_leaks(mined[mode], bench.select(dense_text("name", "file", "body").alias("code"), "comment")).first()
        if leak:
            print(f"error: pairs overlap the benchmark, e.g. {leak['unit_id']}: {leak['reason']}", file=sys.stderr)
            return 1
    for mode, pairs in mined.items():
        store.save_pairs(pairs, f"{args.out_dir}/pairs_{mode}.jsonl")
    stats = report.stats_table(mining.mining_stats(funnel))
    Path(args.out_dir, "stats.md").write_text(f"# Mined pairs\n\n{stats}\n")
    print(stats)
    return 0


def _train(args) -> int:
    import uuid

    from pyspark.sql import functions as F

    from sieveline.operators import dense, training
    from sieveline.sources import registry, store
    from sieveline.sources.scratch import written

    config = registry.run_config(Path(args.config).read_text(), args.run_name)
    spark = _session()
    pairs = store.load_pairs(spark, f"{args.pairs_dir}/pairs_{'random' if config['negatives'] == 'random' else 'hard'}.jsonl").withColumn("pair_id", F.concat_ws("/", "repo", "unit_id"))
    if config["negatives"] != "none" and pairs.where("split = 'train' AND negative = ''").limit(1).count():
        raise ValueError("some training pairs have no negative")
    load = dense.named_embedder(DEFAULT_MODEL)
    vectors = {"q": dense.embed_column("query", load), "d": dense.embed_column("code", load)} | ({"negative": dense.embed_column("negative", load)} if config["negatives"] != "none" else {})
    own = written(pairs.select("pair_id", "split", *(v.cast("array<double>").alias(c) for c, v in vectors.items())), "vectors")
    options = training.Options(batch_size=config["batch_size"], epochs=config["epochs"], learning_rate=config["learning_rate"], warmup_ratio=config["warmup_ratio"], weight_decay=config["weight_decay"], scale=config["scale"], seed=config["seed"], eval_every=config["eval_every"])
    val = own.where("split = 'val'").select("pair_id", "q", "d")

    def mrr(weights) -> float:
        return dense.validation_ranks(training.mapped(val, weights)).agg(F.coalesce(F.avg(1.0 / F.col("rank")), F.lit(0.0))).first()[0]

    log, run_id = registry.RunLog(spark, args.tracking_dir), args.run_id or uuid.uuid4().hex
    with log.run(run_id, config, config["negatives"]) as report:
        train = own.where("split = 'train'")
        state = training.train(train, options, report, mrr, f"{log.path}/artifacts/{run_id}")
        report(state.step, {"final_val_mrr": mrr(state.weights)})
    print(f"run {run_id}: {state.step} steps")
    return 0


def _ablation_text(ranks, reference: str, resamples: int, seed: int) -> str:
    """The table of all models with intervals, and the one by repository; only figures by model, method and repository come to the driver."""
    from sieveline.operators import evaluate
    from sieveline.plans import report
    from sieveline.sources.scratch import written

    ranks = written(ranks, "ranks")
    repos = sorted(r["repo"] for r in ranks.select("repo").distinct().collect())
    table = report.ablation_table(evaluate.ablation(ranks, reference).collect(), reference, evaluate.ablation_intervals(ranks, reference, resamples, seed).collect())
    return "\n".join([table, "", report.by_repo_table(evaluate.mrr_by_repo(ranks, repos).collect(), repos)])


def _ablation(args) -> int:
    from sieveline.operators import dense, evaluate
    from sieveline.plans import bench
    from sieveline.sources.files import parse_repository
    from sieveline.sources.scratch import written

    spark = _session()
    if args.repo:
        models = {m: dense.named_embedder(m) for m in [args.reference, *args.model]}
        ranks = written(bench.ablation_ranks({Path(r).name: written(parse_repository(spark, r), "units") for r in args.repo}, models), "ranks")
        evaluate.rank_dump(ranks).coalesce(1).write.mode("overwrite").text(args.ranks)
    else:
        ranks = evaluate.ranks_table(spark, args.ranks)
    text = _ablation_text(ranks, args.reference, args.resamples, args.seed)
    Path(args.out).write_text(text + "\n")
    print(text)
    return 0


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="sieveline", description="Structure-aware retrieval on Spark.")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, run, model: bool = False, **kw):
        own = commands.add_parser(name, **kw)
        own.set_defaults(run=run)
        if model:
            own.add_argument("--model", default=DEFAULT_MODEL, help="hashed-<dimensions>, or mlflow:best, mlflow:best-<negatives>, mlflow:<run id>")
            own.add_argument("--tracking-dir", default="runs")
        return own

    own = command("index", _index, True, help="parse and save an index")
    own.add_argument("repo")
    own.add_argument("--index-dir")
    own = command("query", _query, True, help="search a repository")
    own.add_argument("repo")
    own.add_argument("query")
    own.add_argument("-k", type=int, default=10)
    own.add_argument("--method", choices=C.METHODS, default="hybrid_graph")
    own.add_argument("--index-dir")
    own.add_argument("--show", action="store_true")
    own = command("bench", _bench, True, help="comment-to-function benchmark")
    own.add_argument("--repo", action="append")
    own.add_argument("--data-dir", help="a folder of repositories")
    own.add_argument("--ablation-model", action="append", help="a model to be compared")
    own.add_argument("--out", default="RESULTS.md")
    own = command("mine", _mine, help="mine training pairs")
    own.add_argument("--training", action="append", required=True)
    own.add_argument("--benchmark", action="append", required=True)
    own.add_argument("--out-dir", default="pairs")
    own.add_argument("--seed", type=int, default=0)
    own = command("train", _train, help="train a map of the queries' vectors on mined pairs")
    own.add_argument("config")
    own.add_argument("run_name")
    own.add_argument("--pairs-dir", default="pairs")
    own.add_argument("--tracking-dir", default="runs")
    own.add_argument("--run-id", help="of a run that was cut off, to go on with")
    own = command("ablation", _ablation, help="compare models by a rank dump, or on repositories, whose ranks are then dumped")
    own.add_argument("ranks")
    own.add_argument("reference")
    own.add_argument("--repo", action="append")
    own.add_argument("--model", action="append", default=[])
    own.add_argument("--out", default="ablation.md")
    own.add_argument("--resamples", type=int, default=C.RESAMPLES)
    own.add_argument("--seed", type=int, default=0)
    return parser


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    try:
        return args.run(args)
    except (LookupError, ValueError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
