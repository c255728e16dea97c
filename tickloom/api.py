"""All operators under one roof, by the names users know them by.

`operators()` has every public function of the engine's modules under its own
name (or `module.name` where two share it), and the names of `ALIASES`."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import arithmetic, containers, convert, dates, eager, scalar, text
from .operators import control, fold, frames, graph, keyed, streams
from .plans import authoring, models
from .sources import frames as sources
from .sources import recording
from .streaming import live, sinks

MODULES = {
    "arithmetic": arithmetic, "containers": containers, "convert": convert, "dates": dates, "scalar": scalar, "text": text, "control": control, "fold": fold, "frames": frames,
    "graph": graph, "keyed": keyed, "streams": streams, "authoring": authoring, "sources": sources, "recording": recording, "live": live, "sinks": sinks, "models": models, "eager": eager,
}


def last_modified_time(us: str) -> Column:
    """The time of a tick is when it was modified."""
    return F.col(us)


def last_modified_wall_clock_time() -> Column:
    return F.current_timestamp()


def print_(template: str, *args: Column, **named: Column) -> Column:
    """The line to print: show it, or write it with the console sink."""
    return text.format_(template, *args, **named)


#: Other names of the same things.
ALIASES: dict[str, Callable] = {
    "from_data_frame": frames.from_frame,
    "from_data_frame_batches": frames.from_frame_batches,
    "to_data_frame": frames.to_frame,
    "replay_data_frame": frames.replay,
    "filter_frame": frames.matching,
    "filter_cs": frames.matching,
    "filter_": streams.filter_by,
    "to_window": streams.window,
    "rolling_window": streams.window,
    "min_ts_list": arithmetic.array_min,
    "max_ts_list": arithmetic.array_max,
    "filter_tsd_by_matches": keyed.filter_by_matches,
    "merge_tsd_disjoint": keyed.merge_disjoint,
    "reduce_tsd_with_race": keyed.race_by_key,
    "reduce_tsd_of_bundles_with_race": keyed.race_by_key,
    "evaluation_time_in_range": streams.time_in_range,
    "stop_engine": sources.stop_at,
    "from_table_const": recording.replay_const,
    "ts_of_frames_from_data_source": sources.tsb_from_data_source,
    "last_modified_time": last_modified_time,
    "last_modified_wall_clock_time": last_modified_wall_clock_time,
    "print_": print_,
}


def operators() -> dict[str, Callable]:
    """Name to function.  A name that several modules use is also found under its module's."""
    found: dict[str, Callable] = {}
    shared = set()
    for module, m in MODULES.items():
        for name, f in vars(m).items():
            if not name.startswith("_") and inspect.isfunction(f) and f.__module__ == m.__name__:
                if name in found:
                    shared.add(name)
                found.setdefault(name, f)
                found[f"{module}.{name}"] = f
    return {n: f for n, f in found.items() if "." not in n or n.split(".")[1] in shared} | {n: f for n, f in ALIASES.items() if n not in found}
