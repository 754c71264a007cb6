"""The engine's verbs over one session: scan, partition, edges, drift, certify."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.functions.text import bucket_of
from sedimark.operators import diff, entities, evidence, gates, graph, inventory, ledger
from sedimark.sources import readers


@dataclass
class Settings:
    """Parameters of a run; `from_conf` reads spark.sedimark.* settings over the defaults."""

    max_tokens: int = 8000
    overlap: float = 0.1
    gitignore: tuple[str, ...] = ()

    @classmethod
    def from_conf(cls, spark: SparkSession, root: str | None = None) -> Settings:
        """spark.sedimark.* over the file .sedimark.json of a tree over the defaults."""
        at = os.path.join(root, ".sedimark.json") if root else ""
        held = {}
        if at and os.path.exists(at):
            with open(at, encoding="utf-8") as f:
                held = json.load(f)
        get = lambda k, d: spark.conf.get(f"spark.sedimark.{k}", str(held.get(k, d)))
        ignore = spark.conf.get("spark.sedimark.gitignore", "|".join(held.get("gitignore", [])))
        return cls(int(get("maxTokens", cls.max_tokens)), float(get("overlap", cls.overlap)), tuple(x for x in ignore.split("|") if x))


class Engine:
    """Lazy DataFrames for each verb (A25); scanners are functions from files to evidence rows and can be added (L)."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None) -> None:
        self.spark, self.settings = spark, settings or Settings.from_conf(spark)
        self.scanners = {"rules": evidence.rule_hits}

    def load(self, root: str, repo: str) -> DataFrame:
        return readers.source_tree(self.spark, root, repo)

    def scan(self, files: DataFrame, names: list[str] | None = None) -> DataFrame:
        """Evidence of the named scanners (all by default), first-seen rows only; an unknown name is an error."""
        chosen = list(dict.fromkeys(names or self.scanners))
        if unknown := [n for n in chosen if n not in self.scanners]:
            raise ValueError(f"unknown scanners: {unknown}")
        out = None
        for n in chosen:
            rows = self.scanners[n](inventory.walked(files, list(self.settings.gitignore)))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out.dropDuplicates(["repo", "file", "line", "rule_id"])

    def partition(self, files: DataFrame) -> DataFrame:
        order = inventory.walk_order(files).join(inventory.tokens_of(files), ["repo", "path"])
        return graph.group_files(order, self.settings.max_tokens, self.settings.overlap)

    def edges(self, files: DataFrame) -> DataFrame:
        java = graph.parsed(files.where("repo is not null"))
        resolved = graph.resolve(graph.imports(java), graph.declarations(java), graph.members(java))
        return graph.cut_edges(resolved, graph.membership(self.partition(files)))

    def entities(self, files: DataFrame) -> DataFrame:
        return entities.entity_map(entities.entities(files))

    def drift(self, signatures: DataFrame) -> DataFrame:
        return diff.file_status(signatures)

    def facts(self, files: DataFrame) -> DataFrame:
        """Evidence facts and the MAPS_TO facts of entities."""
        return evidence.facts(self.scan(files).withColumns({"evidence_id": F.monotonically_increasing_id(), "bucket": bucket_of(F.col("rule_id")), "scanner": F.lit("rules")})).unionByName(
            ledger.maps_to(entities.entities(files)).select(F.lit("MAPS_TO").alias("predicate"), "subject", "object"), allowMissingColumns=True
        )

    def gates(self, rows: DataFrame, files: DataFrame) -> DataFrame:
        """The constraint queries over evidence and files, one after the other."""
        return gates.gate_results({"contract": gates.evidence_violations(rows), "statics": ledger.static_faults(files)})

    def certify(self, artifacts: DataFrame) -> DataFrame:
        return gates.certification_fold(artifacts)
