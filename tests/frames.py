"""Hand-made frames: events, registries, and two visitor populations of opposite taste."""

from __future__ import annotations

import random

from splitlane.schema import REGISTRY

APP = "0" * 23 + "1"
EVENTS = (
    "event_id bigint, app_id string, ts_ms bigint, session string, etype string, "
    "identity map<string,string>, variation string, kind string"
)


def events(spark, rows):
    """Rows of (event_id, session, etype, variation, identity) of one app."""
    full = [
        (i, APP, i * 1000, session, etype, identity or {}, variation, "Random")
        for i, session, etype, variation, identity in rows
    ]
    return spark.createDataFrame(full, EVENTS)


def app(spark, variations=("1", "2"), descriptors=(("browser", True),), state="NoData",
        predicting_from=None, app_id=APP, model_path=None):
    padded = [(v.zfill(24), f"value {v}") for v in variations]
    row = (app_id, state, predicting_from, padded, list(descriptors), model_path,
           "tree_regressor" if model_path else None)
    return spark.createDataFrame([row], REGISTRY)


# The two populations' domains and draw weights.
DOMAINS = {
    "browser": ["Safari 9.0", "Chrome 39.1", "Firefox 10"],
    "os": ["Linux", "Windows", "Mac OS X", "iOS"],
    "lang": ["ru_RU", "en_US", "en_GB", "de_DE"],
}
WEIGHTS_A = {"browser": [10, 65, 25], "os": [1, 70, 20, 8], "lang": [7, 60, 5, 5]}
WEIGHTS_B = {"browser": [25, 10, 65], "os": [8, 1, 70, 20], "lang": [5, 5, 7, 60]}


def visitors(weights, count, seed):
    draws = random.Random(seed)
    return [
        {key: draws.choices(DOMAINS[key], weights[key])[0] for key in DOMAINS} for _ in range(count)
    ]


def two_populations(spark, each=1000, seed=5):
    """Starts with a random variation; a finish when it is the population's favourite."""
    draws = random.Random(seed)
    rows, event_id = [], 0
    people = [(v, 0) for v in visitors(WEIGHTS_A, each, seed + 1)]
    people += [(v, 1) for v in visitors(WEIGHTS_B, each, seed + 2)]
    for session, (identity, favourite) in enumerate(people):
        shown = draws.randrange(2)
        rows.append((event_id, str(session), "start", str(shown + 1).zfill(24), identity))
        event_id += 1
        if shown == favourite:
            rows.append((event_id, str(session), "finish", None, None))
            event_id += 1
    return events(spark, rows)


def population_app(spark, **kwargs):
    return app(
        spark, descriptors=(("browser", True), ("os", True), ("lang", True)), **kwargs
    )
