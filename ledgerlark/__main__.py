"""Command line: ``python -m ledgerlark <job>`` (or through spark-submit).

    profile  DATA OUT           profile tables as JSON
    train    DATA OUT           feature table, models, metrics, reports, cut-offs
    score    REQUESTS RUN OUT   score requests with the best model of a training run
    audit    RUN OUT            leakage and drift audits on the feature table of a run
    tune     RUN OUT            random search over the boosted trees of a run
    compare  RUN_A RUN_B        metrics of two training runs side by side
"""

from __future__ import annotations

import argparse


from ledgerlark.plans import audits, scoring, training
from ledgerlark.plans import transactions as X
from ledgerlark.session import build_session
from ledgerlark.sources import transactions as S


def _best(spark, run: str):
    cut = S.load_parameters(spark, f"{run}/cutoffs")
    name = cut["best_model"]
    return name, S.load_model(f"{run}/models/{name}"), cut


def _score(spark, a) -> None:
    name, model, cut = _best(spark, a.run)
    table = spark.read.parquet(f"{a.run}/features")
    f = X.model_features(table, name.endswith("demographic_free"))
    known = training.fit_encoders(table.where("split = 'train'"), f) if a.explain else None
    requests = spark.read.schema(S.SCORE_REQUEST).parquet(a.requests)
    valid, bad = S.split_valid(requests, S.transaction_rules(with_label=False))
    out = scoring.score_requests(
        valid, model, f, float(cut["prior"]), spark.read.json(f"{a.run}/top_models"),
        {k: float(cut[k]) for k in ("HIGH", "MEDIUM") if k in cut}, name, a.explain, known.neutral if known else None,
    )
    S.write_report(out, f"{a.out}/scores", "parquet")
    S.write_report(bad, f"{a.out}/rejected", "parquet")


def _audit(spark, a) -> None:
    table = spark.read.parquet(f"{a.run}/features")
    f = X.model_features(table, True)
    model, drift = training.standard_models()[2], training.Model("drift", "boosted", training.DRIFT)
    for name, result in audits.audit_tables(table, f, X.TRANSACTION_ENTITIES, X.ROLES, "ReceiverName", model, drift).items():
        S.write_report(result, f"{a.out}/{name}")


def _tune(spark, a) -> None:
    table = spark.read.parquet(f"{a.run}/features")
    f = X.model_features(table, True)
    base = training.Model("hist_gbm", "boosted", training.BOOSTED)
    found = training.search(table, f, base, training.boosted_space, a.trials, ledger=f"{a.out}/trials")
    S.write_report(found, f"{a.out}/ranking")


def main(argv=None) -> None:
    parser = argparse.ArgumentParser(prog="ledgerlark", description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, args in {
        "profile": ("data", "out"), "train": ("data", "out"), "score": ("requests", "run", "out"),
        "audit": ("run", "out"), "tune": ("run", "out"), "compare": ("base", "improved"),
    }.items():
        job = jobs.add_parser(name)
        for arg in args:
            job.add_argument(arg)
        if name == "score":
            job.add_argument("--explain", action="store_true")
        if name == "tune":
            job.add_argument("--trials", type=int, default=30)
        if name == "train":
            job.add_argument("--no-label-rates", action="store_true")
            job.add_argument("--tuned", metavar="OUT", help="output folder of a tune job, whose best trial is used")
    a = parser.parse_args(argv)
    spark = build_session()
    if a.job == "profile":
        X.write_profile(S.read_table(spark, a.data), a.out)
    elif a.job == "train":
        options = X.FeatureOptions(rates=()) if a.no_label_rates else X.FeatureOptions()
        X.train(spark, a.data, a.out, options, trials=f"{a.tuned}/trials" if a.tuned else None)
    elif a.job == "compare":
        X.compare(spark, a.base, a.improved).show(100, truncate=False)
    else:
        {"score": _score, "audit": _audit, "tune": _tune}[a.job](spark, a)


if __name__ == "__main__":
    main()
