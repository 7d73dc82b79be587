"""Interactive menu: python -m tracewarden.plans.cli LOG"""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession

from tracewarden.functions.timeparse import time_range
from tracewarden.operators import journeys
from tracewarden.operators.rules import detect
from tracewarden.plans import report
from tracewarden.sources.scratch import durable
from tracewarden.sources.snapshot import open_log, report_path

MENU = "1 user journey  2 resource history  3 top resources  4 anomalies  5 reload  0 quit"


def show(rows: DataFrame, ask=input, out=print, size: int = 50) -> None:
    """Pages of rows; q stops."""
    number = 0
    while True:
        some = journeys.page(rows, number, size).collect()
        for r in some:
            out("  ".join(str(v) for v in r))
        if len(some) < size or ask("more? (q stops) ").strip().lower() == "q":
            return
        number += 1


def run(spark: SparkSession, source: str, ask=input, out=print) -> None:
    events = open_log(spark, source)
    out(f"{events.count()} events")
    while (choice := ask(f"{MENU}\n> ").strip()) != "0":
        began = time.time()
        try:
            if choice in ("1", "2"):
                column, query = (("user_id", journeys.user_journey), ("resource_id", journeys.resource_history))[int(choice) - 1]
                value = ask(f"{column} (empty: the first): ").strip() or journeys.default_keys(events).first()[column]
                start, end = time_range(ask("from: "), ask("to: "))
                state = journeys.status(events, column, value or "", start, end)
                if state == "found":
                    show(query(events, value, start, end), ask, out)
                else:
                    out({"unknown": f"{value} does not occur", "empty": "no events in this range"}[state])
            elif choice == "3":
                show(journeys.top_resources(events, *time_range(ask("from: "), ask("to: "))).orderBy("rank"), ask, out)
            elif choice == "4":
                found = durable(detect(events), "alerts")
                out(report.render(found, events))
                report.write_csv(found, events, report_path(source), single_file=True)
            elif choice == "5":
                events = open_log(spark, source, reload=True)
        except ValueError as e:
            out(str(e))
        out(f"{1000 * (time.time() - began):.0f} ms")


if __name__ == "__main__":
    run(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), sys.argv[1] if len(sys.argv) > 1 else "data.csv")
