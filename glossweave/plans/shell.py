"""A small shell over ontology tables: ``gs name`` looks a synset up, ``gr name`` lists its relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.operators.ontology import get_synset

HELP = "gs NAME: the synset of a name lemma.pos.number; gr NAME: its relations; help; quit"


def answer(line: str, senses: DataFrame, relation: DataFrame) -> list[str]:
    """What the shell says to one line."""
    command, _, name = line.strip().partition(" ")
    if command not in ("gs", "gr"):
        return [HELP]
    found = get_synset(senses.sparkSession.createDataFrame([(name.strip(),)], ["name"]), senses).first().id
    if found is None:
        return [f"no synset {name.strip()}"]
    if command == "gs":
        return [found]
    return [f"{r.rel} {r.dst}" for r in relation.where(F.col("src") == found).orderBy("rel", "dst").collect()]


def run(senses: DataFrame, relation: DataFrame, read: Callable[[str], str] = input, write: Callable[[str], None] = print) -> None:
    while (line := read("> ").strip()) not in ("quit", "exit"):
        for said in answer(line, senses, relation):
            write(said)
