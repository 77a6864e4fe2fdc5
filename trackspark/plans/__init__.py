"""Registered queries, grouped by family.

Plan modules build Column expressions while they load, which needs a running Spark session. The
names and oracle texts are therefore also kept in `oracles.json`, so they can be listed without
one. `python -m trackspark.plans.export` rewrites that file; a test checks that it is current.
"""

import importlib
import json
from pathlib import Path

FAMILIES = ["scalars", "frames", "sequences", "metrics", "audits", "review", "machine", "files", "streams"]
LISTING = Path(__file__).with_name("oracles.json")


def load() -> None:
    """Import every plan module; needs a running session."""
    for family in FAMILIES:
        importlib.import_module(f"trackspark.plans.{family}")


def listing() -> dict[str, str | None]:
    """Query name -> oracle SQL, or None where there is no oracle."""
    return json.loads(LISTING.read_text(encoding="utf-8"))
