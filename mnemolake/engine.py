"""The tool surface as plain methods over snapshots.

An Engine holds tables by name. Readers return DataFrames; writers put a new snapshot in place of the old one and return
what they changed. Queries come as DataFrames of many rows, never one at a time. What needs a language model, a window
title or a sensor takes its answer as an argument.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import text as X
from .maintenance import Maintenance
from .operators import folds, search, similar
from .operators.numbering import numbered
from .operators.text_index import SegmentedIndex
from .operators.upsert import merged_into
from .plans import lifecycle
from .plans.aggregates import agg_profile
from .plans.graphs import project_links
from .plans.retrieval import completed, repeat_score
from .plans.similar import dedup, similar_to
from .plans.text import EMOTIONS
from .rules import Rules
from .schema import NOW, lookup
from .sources.scratch import cut
from .sources.snapshots import Snapshots

#: The memory type of each kind of project note.
NOTE_TYPES = {"decision": "decision", "pitfall": "lesson", "convention": "fact", "idea": "thought"}


class Engine:
    #: The names of the tools by group, as callers know them.
    GROUPS = {
        "memory": ["memory_store", "memory_search", "memory_get", "memory_delete", "memory_stats", "dissonance_check", "context_compression_stats", "directive_add", "directive_list", "directive_deactivate", "directive_stats", "anti_repeat_record", "anti_repeat_check", "anti_repeat_penalty", "anti_repeat_clear", "anti_repeat_stats", "reflection_synthesize", "reflection_read", "reflection_apply_evidence", "reflection_promote", "reflection_stats"],
        "self": ["analyze_emotion", "emotion_status", "emotion_label", "self_model", "self_reflect", "self_discover", "latest_thought", "curiosity_check", "subconscious", "reflect_run_op", "narrative_generate", "proactive_check", "activity_status"],
        "care": ["care_check", "care_status"],
        "vitality": ["vitality", "vitality_tick"],
        "relationship": ["relationship", "relationship_tick"],
        "skill": ["skill_write", "skill_list", "skill_get", "skill_search", "skill_remove"],
        "project": ["project_note", "project_retrieve", "project_stats"],
    }

    def __init__(self, tables: dict[str, DataFrame], now: float = NOW, ttl: float = 20.0, index: SegmentedIndex | None = None, stored: dict[str, Snapshots] | None = None):
        """With an index of the memory table, every write to the table goes to the index as well, and searches read it.

        Tables (with ids) that are `stored` are written there by each tool that changes them and read back, so a session of
        any length reads one version; others stay lazy plans over what they were made of. A stored table that holds no
        version yet takes the one given.
        """
        self.t, self.now, self.ttl, self.index, self.stored = tables, now, ttl, index, stored or {}
        for name, store in self.stored.items():
            if store.version()[1]["schema"] is None:
                store.replace("first", self.t[name])
            self.t[name] = store.read()
        self._cache: dict[str, tuple[float, DataFrame]] = {}
        self.rules = {"input": Rules(), "memory": Rules(), "query": Rules(), "entity": Rules()}
        self.maintenance = Maintenance()
        for op, every in lifecycle.INTERVALS.items():
            self.maintenance.register(op, lambda op=op: self.reflect_run_op(op), every)

    def tools(self, groups: list[str] | None = None) -> list[str]:
        """Names of the tools of these groups; unknown groups alone give all."""
        known = [g for g in groups or [] if g in self.GROUPS]
        return [n for g in known or self.GROUPS for n in self.GROUPS[g]]

    def _replace(self, name: str, df: DataFrame) -> DataFrame:
        self._cache.clear()
        if name in self.stored:
            self.stored[name].replace(uuid.uuid4().hex, df)
            df = self.stored[name].read()
        self.t[name] = df
        return df

    def _merged(self, name: str, rows: DataFrame) -> None:
        """Rows in place of those of their ids, or beside the others."""
        self._cache.clear()
        if name in self.stored:
            self.stored[name].merge(uuid.uuid4().hex, rows)
            self.t[name] = self.stored[name].read()
        else:
            self.t[name] = self.t[name].join(rows.select("id"), "id", "left_anti").unionByName(rows, allowMissingColumns=True)

    def _append(self, name: str, rows: DataFrame) -> DataFrame:
        if name in self.stored:
            self._merged(name, rows)
            return rows
        self._replace(name, self.t[name].unionByName(rows, allowMissingColumns=True))
        return rows

    def _drop(self, name: str, ids: DataFrame) -> DataFrame:
        if name in self.stored:
            self._cache.clear()
            self.stored[name].merge(uuid.uuid4().hex, gone=ids)
            self.t[name] = self.stored[name].read()
            return self.t[name]
        return self._replace(name, self.t[name].join(ids, "id", "left_anti"))

    # memory
    def memory_store(self, rows: DataFrame, order: Column) -> DataFrame:
        """Merge rows (content, type, tags, weight ...) into the memories that they repeat, insert the others; gives the rows as stored.

        Weights are clamped; rows that fail a rule of severity error are refused; ids of inserted rows follow the largest one in a stated order. Rows with a v5_key tag are always
        inserted. Rows of one call are compared with the snapshot before it, not with each other.
        """
        memory = self.t["memory"]
        rows = rows.withColumn("weight", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "weight")))
        rows = self.rules["memory"].accepted(rows)
        top = memory.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("_top"))
        new = cut(numbered(rows, [order], "_n").join(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_n")))
        free = new.where(F.col("tags").isNull() | ~F.col("tags").contains("v5_key:"))
        into = cut(similar_to(free, memory).select("id", F.col("old_id").alias("_into")))
        fresh = numbered(new.join(into, "id", "left_anti"), [F.col("_n")], "_m").withColumn("id", F.col("_top") + F.col("_m")).drop("_top", "_n", "_m")
        fresh = fresh.withColumn("created", F.lit(self.now)).withColumn("archived", F.lit(False))
        x = merged_into(memory, new, into, self.now)
        stored = cut(x.where("_hit").drop("_hit").unionByName(fresh, allowMissingColumns=True))
        self._merged("memory", stored)
        if self.index is not None:
            self.index.upsert(stored)
        return stored

    def memory_search(self, queries: DataFrame, query_vectors: DataFrame, times: DataFrame, k: int = 5, *, key: str | None = None) -> DataFrame:
        """The fused search; queries left short are filled up by their words, then by notes (`notes`: note_id, title, body).

        Under a key the batch's result is written and
        answered from there for `ttl` seconds, or until a table changes; of over 200 results the 50 oldest go.
        """
        if key in self._cache and time.monotonic() - self._cache[key][0] < self.ttl:
            return self._cache[key][1]
        found = search.retrieve(search.scored(search.candidates(self.t["memory"], self.t["vectors"], queries, query_vectors, times, k, self.index), queries, self.now), k)
        notes = self.t["notes"] if "notes" in self.t else queries.sparkSession.createDataFrame([], "note_id long, title string, body string")
        out = completed(found, self.t["memory"], queries, notes, k)
        if key is not None:
            out = cut(out)
            if len(self._cache) >= 200:
                for old in sorted(self._cache, key=lambda x: self._cache[x][0])[:50]:
                    del self._cache[old]
            self._cache[key] = time.monotonic(), out
        return out

    def memory_get(self, ids: DataFrame) -> DataFrame:
        return self.t["memory"].join(ids, "id", "left_semi")

    def memory_delete(self, ids: DataFrame) -> DataFrame:
        if self.index is not None:
            self.index.delete(ids)
        return self._drop("memory", ids)

    def memory_stats(self) -> DataFrame:
        return self.t["memory"].groupingSets([["type"], []], "type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("weight"), 3).alias("avg_weight"))

    def dissonance_check(self, verdicts: DataFrame) -> DataFrame:
        """verdicts: ids that contradict a newer fact; they lose support and are closed once."""
        hit = F.col("_hit").isNotNull()
        m = self.t["memory"].join(verdicts.select("id", F.lit(True).alias("_hit")), "id", "left")
        m = m.withColumn("reinforcement", F.when(hit, F.greatest(F.lit(-2.0), F.col("reinforcement") - 0.5)).otherwise(F.col("reinforcement"))).withColumn("valid_to", F.when(hit & F.col("valid_to").isNull(), self.now).otherwise(F.col("valid_to")))
        return self._replace("memory", m.drop("_hit"))

    def context_compression_stats(self) -> DataFrame:
        return self.t["memory"].select("id", F.length("content").alias("before"), F.length(X.collapse(F.col("content"))).alias("after"))

    def directive_add(self, rows: DataFrame, keep: int = 50) -> DataFrame:
        """The newest `keep` of each character stay, then the new ones are added."""
        n = F.row_number().over(Window.partitionBy("character").orderBy(F.desc("created_at"), F.desc("id")))
        self._replace("directives", self.t["directives"].withColumn("_n", n).where(F.col("_n") <= keep).drop("_n"))
        return self._append("directives", rows)

    def directive_list(self, character: str) -> DataFrame:
        return self.t["directives"].where((F.col("character") == character) & F.col("is_active") & ((F.col("expires_at") == 0) | (F.col("expires_at") > self.now))).orderBy("created_at", "id")

    def directive_deactivate(self, ids: DataFrame) -> DataFrame:
        d = self.t["directives"].join(ids.select("id", F.lit(True).alias("_off")), "id", "left")
        return self._replace("directives", d.withColumn("is_active", F.col("is_active") & F.col("_off").isNull()).drop("_off"))

    def directive_stats(self) -> DataFrame:
        return self.t["directives"].groupBy("character").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_active").alias("n_active"))

    def anti_repeat_record(self, responses: DataFrame) -> DataFrame:
        return self._append("responses", responses)

    def _ngrams(self) -> DataFrame:
        g = self.t["responses"].select("character", "turn", F.explode(X.repeat_grams(F.col("text"), 5)).alias("ngram"))
        return g.groupBy("character", "ngram").agg(F.count(F.lit(1)).alias("n"))

    def anti_repeat_check(self, candidates: DataFrame) -> DataFrame:
        """The weighted score of candidates (character, text) against the 500 heaviest 5-grams that their character has used."""
        return repeat_score(self.t["responses"], candidates).drop("known")

    def anti_repeat_penalty(self, candidates: DataFrame, over: float = 0.5) -> DataFrame:
        """Candidates whose score is over the limit."""
        return self.anti_repeat_check(candidates).where(F.col("score") > over)

    def anti_repeat_clear(self, character) -> DataFrame:
        return self._replace("responses", self.t["responses"].where(F.col("character") != character))

    def anti_repeat_stats(self) -> DataFrame:
        return self._ngrams().groupBy("character").agg(F.count(F.lit(1)).alias("ngrams"), F.max("n").alias("most"))

    def reflection_synthesize(self, rows: DataFrame) -> DataFrame:
        return self._append("reflections", rows)

    def reflection_read(self, character: str, status: str | None = None, limit: int = 20) -> DataFrame:
        r = self.t["reflections"].where(F.col("character") == character)
        return (r.where(F.col("status") == status) if status else r).orderBy(F.desc("importance"), F.desc("created_at"), "id").limit(limit)

    def reflection_apply_evidence(self, evidence: DataFrame) -> DataFrame:
        """evidence (id, delta_rein, delta_disp): summed by id and added."""
        d = evidence.groupBy("id").agg(F.sum("delta_rein").alias("_r"), F.sum("delta_disp").alias("_d"))
        r = self.t["reflections"].join(d, "id", "left").withColumn("reinforcement", F.col("reinforcement") + F.coalesce("_r", F.lit(0.0))).withColumn("disputation", F.col("disputation") + F.coalesce("_d", F.lit(0.0)))
        return self._replace("reflections", r.drop("_r", "_d"))

    def reflection_promote(self) -> DataFrame:
        return lifecycle.checked(self.t["reflections"])

    def reflection_stats(self) -> DataFrame:
        return self.t["reflections"].groupBy("status").agg(F.count(F.lit(1)).alias("n"))

    # self
    def analyze_emotion(self, texts: DataFrame) -> DataFrame:
        return texts.withColumn("emotion", X.first_of(F.lower("text"), EMOTIONS, "平静"))

    def emotion_status(self) -> DataFrame:
        return folds.fold(self.t["interactions"], "affect")

    def emotion_label(self) -> DataFrame:
        from .plans.text import math_mood_tags

        return math_mood_tags(self.t)

    def self_model(self) -> DataFrame:
        return self.t["memory"].where("type = 'identity' AND NOT archived").orderBy(F.desc("weight"), "id")

    def self_reflect(self) -> DataFrame:
        return lifecycle.life_narrative(self.t)

    def self_discover(self) -> DataFrame:
        return self.t["memory"].where("type IN ('user_trait', 'lesson')").groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.max_by("content", "weight").alias("strongest"))

    def latest_thought(self) -> DataFrame:
        return self.t["memory"].orderBy(F.desc("created"), F.desc("id")).limit(1)

    def curiosity_check(self) -> DataFrame:
        return folds.fold(self.t["interactions"], "curiosity")

    def subconscious(self) -> DataFrame:
        from .plans.folds import st_emotion_event

        return st_emotion_event(self.t)

    def reflect_run_op(self, op: str) -> DataFrame:
        """An operation of the default scheduler; those that change a table put the next snapshot in place."""
        if op == "retention":
            return self._replace("memory", lifecycle.retention(self.t["memory"], self.now).drop("action"))
        if op == "dedup":
            dup = dedup(self.t).where("duplicate").select("id", F.lit(True).alias("_dup"))
            return self._replace("memory", cut(self.t["memory"].join(dup, "id", "left").withColumn("archived", F.col("archived") | F.coalesce("_dup", F.lit(False))).drop("_dup")))
        if op == "expire_directives":
            return self._replace("directives", self.t["directives"].withColumn("is_active", F.col("is_active") & ((F.col("expires_at") == 0) | (F.col("expires_at") > self.now))))
        ops = {"cleanup": lifecycle.life_cleanup, "vector_sync": lifecycle.life_vector_sync, "reflection_promote": lambda t: lifecycle.checked(t["reflections"]), "profile_sync": agg_profile, "temporal_extract": lambda t: lifecycle.extracted(t["memory"])}
        return ops[op](self.t)

    def narrative_generate(self) -> DataFrame:
        return lifecycle.life_narrative(self.t)

    def proactive_check(self) -> DataFrame:
        from .plans.folds import st_proactive

        return st_proactive(self.t)

    def activity_status(self) -> DataFrame:
        from .plans.text import str_activity

        return str_activity(self.t)

    # care, vitality, relationship
    def care_check(self) -> DataFrame:
        return folds.fold(self.t["interactions"], "care").where("reminders > 0")

    def care_status(self) -> DataFrame:
        return folds.fold(self.t["interactions"], "care")

    def vitality(self) -> DataFrame:
        return folds.fold(self.t["interactions"], "vitality")

    def vitality_tick(self, events: DataFrame) -> DataFrame:
        self._append("interactions", events)
        return self.vitality()

    def relationship(self) -> DataFrame:
        return folds.fold(self.t["interactions"], "relationship")

    def relationship_tick(self, events: DataFrame) -> DataFrame:
        self._append("interactions", events)
        return self.relationship()

    # skills and projects
    def skill_write(self, rows: DataFrame) -> DataFrame:
        """Kebab-case names with a description replace the skill of that name, the largest id of a call wins; others are refused."""
        rows = rows.where(F.col("name").rlike("^[a-z0-9]+(-[a-z0-9]+)*$") & (F.col("description") != ""))
        rows = cut(rows.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("id")))).where("_n = 1").drop("_n"))
        self._replace("skills", self.t["skills"].join(rows.select("name"), "name", "left_anti").select(*self.t["skills"].columns))
        return self._append("skills", rows)

    def skill_list(self) -> DataFrame:
        return self.t["skills"].select("id", "name", "description")

    def skill_get(self, name: str) -> DataFrame:
        return self.t["skills"].where(F.col("name") == name)

    def skill_search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """queries (query_id, q): name over description over body."""
        s = self.t["skills"].join(search.small(queries.withColumn("_ws", X.query_tokens(F.col("q")))))
        point = lambda x: F.when(F.col("name").contains(x), 3).otherwise(0) + F.when(F.lower("description").contains(x), 2).otherwise(0) + F.when(F.lower("body").contains(x), 1).otherwise(0)
        total = F.when(F.col("name").contains(F.lower("q")), 6).otherwise(0) + F.aggregate(F.transform("_ws", point), F.lit(0), lambda a, b: a + b)
        s = s.withColumn("score", F.least(6 + 2 * F.size("_ws") + 3, total)).where("score > 0").drop("_ws")
        return search.ranked(s, [F.desc("score"), F.col("id")], k)

    def skill_remove(self, ids: DataFrame) -> DataFrame:
        return self._drop("skills", ids)

    def project_note(self, rows: DataFrame, order: Column) -> DataFrame:
        """Store notes (content, kind, project, tags, weight) under their project and link them to notes of other kinds; unknown kinds are refused."""
        kind = F.lower(F.trim(F.coalesce("kind", F.lit("decision"))))
        rows = rows.withColumn("kind", kind).where(F.col("kind").isin(list(NOTE_TYPES)))
        own = F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
        tags = F.concat(own, F.array(F.concat(F.lit("v5_project:"), "project"), F.concat(F.lit("v5_kind:"), "kind"), F.lit("v5_domain:project")))
        notes = rows.withColumn("tags", F.array_join(F.array_distinct(tags), ",")).withColumn("type", lookup(NOTE_TYPES, F.col("kind"), "decision")).drop("kind", "project")
        stored = cut(self.memory_store(notes, order))
        self._append("project_edges", cut(project_links(self.t["memory"].withColumn("tags", F.regexp_replace("tags", r"\s+", ",")), stored.select("id"))))
        return stored

    def project_retrieve(self, project: str, needle: str, k: int = 20) -> DataFrame:
        m = self.t["memory"].where(F.array_contains(F.split("tags", r"[,\s]+"), f"v5_project:{project}") & X.like(F.col("content"), F.lit(needle)))
        return m.orderBy(F.desc("weight"), F.desc("id")).limit(k)

    def project_stats(self) -> DataFrame:
        from .plans.aggregates import agg_project_stats

        return agg_project_stats(self.t)

    def upsert_pairs(self, old: Column, new: Column) -> Column:
        return similar.matches(old, new, 0.75)
