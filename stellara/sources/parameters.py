"""Startup parameters as name:value arguments."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, fields


#: The parameters' names and defaults.
@dataclass
class Parameters:
    num_of_cores: int = 4
    port_id: int = 9999
    client: str = "localhost"
    data_path: str = "/tmp/ssb_data/"
    run_type: str = "full"
    part_size: int = 128_000
    dax_queue_size: int = 4
    sf: int = 1
    scheduling: str = "operator_at_a_time"
    query_path: str = ""
    q_id: str = "ssb/3_1.txt"
    join_rw: str = "off"
    agg_rw: str = "off"


#: What a toy run sets, whatever else is given.
TOY = {"part_size": 12_800, "dax_queue_size": 1, "num_of_cores": 1}


def parse(arguments: list[str]) -> Parameters:
    """Unknown names are warned of and left out; an argument without a colon is an error. A toy run is small.

    The address, the queue of a device and the scheduling are Spark's own affair here: they are taken and not used.
    """
    kinds, out = {f.name: type(f.default) for f in fields(Parameters)}, Parameters()
    for argument in arguments:
        name, colon, value = argument.partition(":")
        if not colon:
            raise ValueError(f"{argument!r} is not name:value")
        if name in kinds:
            setattr(out, name, kinds[name](value))
        else:
            warnings.warn(f"unknown parameter {name!r}", stacklevel=2)
    if out.run_type == "toy":
        for name, value in TOY.items():
            setattr(out, name, value)
    return out
