"""Cluster files: partitions, replication, virtual nodes and addresses, one directive a line."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# What holds for directives that a file leaves out.
PARTITIONS, REPLICATION, VNODES = 8, 3, 64


@dataclass
class ClusterConfig:
    partitions: int = PARTITIONS
    replication: int = REPLICATION
    vnodes: int = VNODES
    nodes: dict[int, str] = field(default_factory=dict)

    def node_ids(self) -> list[int]:
        return sorted(self.nodes)


class ConfigError(ValueError):
    pass


def parse(text: str) -> ClusterConfig:
    """Reads directives ``partitions N``, ``replication N``, ``vnodes N`` and ``node ID HOST:PORT``.

    ``#`` starts a comment; what follows a directive's values is ignored; of two nodes with one id the later counts. Errors
    name the line; a file without nodes is one.
    """
    config = ClusterConfig()
    for number, line in enumerate(text.splitlines(), 1):
        words = line.split("#", 1)[0].split()
        if not words:
            continue
        name, values = words[0], words[1:]
        if name in ("partitions", "replication", "vnodes"):
            if not values or not re.fullmatch("[0-9]+", values[0]) or int(values[0]) < 1:
                raise ConfigError(f"line {number}: {name} needs a positive number")
            setattr(config, name, int(values[0]))
        elif name == "node":
            if len(values) < 2 or not re.fullmatch("[0-9]+", values[0]):
                raise ConfigError(f"line {number}: node needs an id and an address")
            config.nodes[int(values[0])] = values[1]
        else:
            raise ConfigError(f"line {number}: unknown directive {name}")
    if not config.nodes:
        raise ConfigError("the file names no nodes")
    return config


def load(path: str) -> ClusterConfig:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())
