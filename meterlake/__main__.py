"""python -m meterlake seed SOURCE TARGET | query NAME SF_DIR | stream SOURCE STATE TARGET

seed makes the state tables from Parquet tables below SOURCE; stream applies JSON files below SOURCE/usage and
SOURCE/changes, with the state tables below STATE.
"""

from __future__ import annotations

import sys

from meterlake.operators import versioned
from meterlake.plans import catalog, seed
from meterlake.session import local_session
from meterlake.streaming import job


def main(args: list[str]) -> int:
    if len(args) < 3:
        print(__doc__)
        return 2
    spark, (command, *rest) = local_session(), args
    read = spark.read.parquet
    if command == "seed":
        print(*seed.load({t: read(f"{rest[0]}/{t}") for t in seed.TABLES}, rest[1]))
    elif command == "query":
        catalog.queries()[rest[0]](spark, rest[1]).show(50, truncate=False)
    elif command == "stream" and len(rest) == 3:
        source, state, target = rest
        plans, gifts, families, members, scores = (read(f"{state}/{t}") for t in ("plan_limit", "gift", "family_limit", "family_member", "family_priority"))
        subscribers, pools = versioned.stored_subscribers(plans, gifts), versioned.stored_families(families, members, scores)
        job.run_files(spark, f"{source}/usage", target, subscribers, pools, f"{source}/changes").awaitTermination()
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
