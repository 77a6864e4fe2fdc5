"""Write the query listing: `python -m trackspark.plans.export`."""

import json

from trackspark import plans
from trackspark.plans import registry
from trackspark.session import local_session


def current() -> dict[str, str | None]:
    plans.load()
    return {name: registry.ORACLES.get(name) for name in registry.QUERIES}


if __name__ == "__main__":
    local_session("2")
    plans.LISTING.write_text(json.dumps(current(), indent=1), encoding="utf-8")
