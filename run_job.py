"""Run all analyses, e.g.

spark-submit run_job.py --table units=Units.csv --table primary_person=Persons.csv --table charges=Charges.csv \
    --table damages=Damages.csv --output results --staging staged
"""

import argparse

from pyspark.sql import DataFrame, SparkSession

from crashlens.plans.job import answers, result_paths, run_all


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--table", action="append", required=True, metavar="NAME=PATH")
    parser.add_argument("--output", required=True, help="folder for the ten result datasets")
    parser.add_argument("--format", default="csv", help="format of the tables")
    parser.add_argument("--staging", help="folder to store the tables as typed Parquet first; CSV needs one")
    parser.add_argument("--all-pairs", action="store_true", help="store every pair of the fourth analysis")
    parser.add_argument("--on-bad", choices=["raise", "reject", "keep"], default="raise", help="CSV records with too few or too many fields: fail, store beside the staged table, or fill and cut")
    parser.add_argument("--manifest", help="folder of notes on finished steps; a stopped run is taken up by the same command")
    parser.add_argument("--at-once", type=int, default=1, help="analyses that run at the same time")
    args = parser.parse_args()

    spark = SparkSession.builder.appName("crashlens").getOrCreate()
    inputs = dict(table.split("=", 1) for table in args.table)
    outputs = result_paths(args.output)
    stored = run_all(spark, inputs, outputs, args.format, args.staging, args.all_pairs, args.on_bad, args.manifest, args.at_once)
    for name, answer in answers(stored).items():
        if isinstance(answer, DataFrame):
            print(name)
            answer.show()
        else:
            print(name, answer)
    spark.stop()


if __name__ == "__main__":
    main()
