"""Search for expressions, or test found ones on other days.

python -m factorweave.plans --panel PATH --out PATH [--warm_start 10 | --warm_start CSV]
python -m factorweave.plans --panel PATH --out PATH --evaluate_from 2022-01-01
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorweave.functions.stats import DAY, INDUSTRY, SECU
from factorweave.operators.ic import with_return
from factorweave.operators.search import Search, revalidate
from factorweave.plans.compiler import evaluate
from factorweave.sources.panel import read_warm_start, write_report


def return_to_explain(panel: DataFrame, ret: str, shift: int | None = 2, ind_neu: bool = False, derisk: bool = False) -> DataFrame:
    """panel with `ret`: the return of a column `shift` rows later, of its derisked form or neutral to industries if wanted."""
    name = f"{ret}_derisked" if derisk else ret
    if name not in panel.columns:
        raise ValueError(f"the panel has no return {name}")
    if ind_neu:
        own = panel.withColumn("kept_industry", F.col(INDUSTRY))
        others = [c for c in own.columns if c not in (SECU, DAY, INDUSTRY, "neutral_return")]
        panel = evaluate(own, {"neutral_return": f"ind_neu({name})"}, keep=others).withColumnRenamed("kept_industry", INDUSTRY)
        name = "neutral_return"
    return with_return(panel, name, shift)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="factorweave.plans", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--panel", required=True, help="Parquet panel with SecuCode, TradingDay and the leaf columns")
    p.add_argument("--out", required=True, help="folder: fitness and values by epoch, and the out-of-sample report")
    p.add_argument("--ret", default="raw_close_close")
    p.add_argument("--ret_shift", type=int, default=2)
    p.add_argument("--ind_neu", action=argparse.BooleanOptionalAction, default=False, help="explain the return less its industry's mean of the day, over their deviation")
    p.add_argument("--derisk", action=argparse.BooleanOptionalAction, default=False, help="explain the column of that name with _derisked behind it")
    p.add_argument("--epochs", type=int, default=20)
    p.add_argument("--max_depth", type=int, default=3)
    p.add_argument("--population_size", type=int, default=2000)
    p.add_argument("--warm_start", default="10", help="best of so many times the population (1 for none), or a fitness CSV to start from")
    p.add_argument("--pc_threshold", type=float, default=None)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--log", default=None, help="a file for the run's log; by default it goes to the console")
    p.add_argument("--evaluate_from", default=None, help="no search: test the stored factors from this day on")
    p.add_argument("--evaluate_to", default=None)
    a = p.parse_args(args)
    logging.basicConfig(filename=a.log, level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.getOrCreate()
    panel = return_to_explain(spark.read.parquet(a.panel), a.ret, a.ret_shift, a.ind_neu, a.derisk)
    if a.evaluate_from:
        write_report(revalidate(panel, f"{a.out}/fitness", a.evaluate_from, a.evaluate_to), f"{a.out}/out_of_sample")
        return
    columns = [c for c in Search().columns if c in panel.columns]
    times = int(a.warm_start) if a.warm_start.isdigit() else 1
    given = [] if a.warm_start.isdigit() else read_warm_start(spark, a.warm_start, a.population_size)
    search = Search(a.population_size, a.epochs, a.max_depth, a.seed, times, pc_threshold=a.pc_threshold, columns=columns)
    for epoch in search.fit(panel, given, a.out):
        print(epoch["epoch"], epoch["report"])


if __name__ == "__main__":
    main()
