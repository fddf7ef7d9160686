"""Events from parsed sentences: a function of one sentence's tokens, run in Arrow batches, and pairs from events.

A sentence is a row of sentence_id and nodes, an array of tokens in order: i, text, lemma, pos, dep, head_i (-1 at a
root) and is_nominalized. Protein mentions are tokens PROTEINn. The parser itself is outside: its output is the input.

Channels, in this order: clauses (a verb's subjects, objects and agents), nominal events (nominalised nouns and their
`of`, `by`, `between`, `with`, `to`), states (complexes of two proteins and more), and relation statements (appositions
and copulas, which name rather than interact). A token that an earlier channel used as an inner event isn't used again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import projected_pairs

NODES = "array<struct<i:int,text:string,lemma:string,pos:string,dep:string,head_i:int,is_nominalized:boolean>>"
EVENTS = """sentence_id string, seq int, channel string, event_type string, predicate string, construction string, directed boolean,
    assertion_status string, sources array<int>, targets array<int>, participants array<int>, aligned boolean"""

#: Default cue words and dependency names of the rules here; a corpus's own lists are read with `corpora.read_lexicon`.
NEGATION = {"not", "no", "neither", "nor", "never", "without", "n't"}
UNCERTAINTY = {"may", "might", "could", "possibly", "possible", "suggest", "propose", "whether", "potential", "putative", "likely"}
SUBJECTS, PASSIVE_SUBJECTS = {"nsubj", "csubj"}, {"nsubjpass", "nsubj:pass", "csubjpass"}
OBJECTS, OBLIQUES = {"obj", "dobj", "iobj"}, {"obl", "nmod", "obl:agent", "nmod:by", "nmod:of", "nmod:with"}
SAME_PHRASE = {"compound", "amod", "nmod:poss", "flat", "appos"}
BINARY = {"between", "with", "to", "among"}
MARKER = re.compile(r"PROTEIN(\d+)")


def marker_numbers(text: Column) -> Column:
    """Numbers of the protein markers of a text, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"PROTEIN(\d+)"), 1), lambda x: x.cast("int"))))


class Sentence:
    def __init__(self, nodes: list[dict]):
        self.nodes = nodes
        self.below: dict[int, list[int]] = {}
        for n in nodes:
            if n["head_i"] is not None and n["head_i"] >= 0 and n["head_i"] != n["i"]:
                self.below.setdefault(n["head_i"], []).append(n["i"])
        self.at = {n["i"]: n for n in nodes}

    def children(self, i: int, deps: set[str]) -> list[int]:
        return [c for c in self.below.get(i, []) if self.at[c]["dep"] in deps]

    def case(self, i: int) -> str:
        """The preposition of a phrase, from its case marker or its dependency's subtype."""
        marks = [self.at[c]["lemma"].lower() for c in self.below.get(i, []) if self.at[c]["dep"] in ("case", "mark")]
        return marks[0] if marks else (self.at[i]["dep"].partition(":")[2] if self.at[i]["dep"] != "obl:agent" else "by")

    def conjuncts(self, i: int) -> list[int]:
        """A token and those coordinated with it; one with a negation of its own is left out, but not what hangs below it."""
        out, stack, seen = [], [i], set()
        while stack:
            t = stack.pop(0)
            if t in seen:
                continue
            seen.add(t)
            if t == i or not self.negated_here(t):
                out.append(t)
            stack += self.children(t, {"conj"})
        return out

    def negated_here(self, i: int) -> bool:
        return any(self.at[c]["dep"] == "neg" or self.at[c]["lemma"].lower() in NEGATION for c in self.below.get(i, []) if self.at[c]["dep"] not in ("conj", "obl", "nmod", "obj", "nsubj"))

    def proteins(self, i: int, of: bool = True) -> list[int]:
        """Proteins of a phrase: of its head and conjuncts, of modifiers in the same phrase, and of its `of` complements."""
        out: list[int] = []
        for t in self.conjuncts(i):
            m = MARKER.search(self.at[t]["text"])
            own = [int(m[1])] if m else []
            for c in self.below.get(t, []):
                if self.at[c]["dep"] in SAME_PHRASE or (of and not m and self.at[c]["dep"].startswith("nmod") and self.case(c) == "of"):
                    own += self.proteins(c)
            out += [p for p in own if p not in out]
        return out

    def assertion(self, i: int) -> str:
        """negated by a cue at the token or an auxiliary of it, uncertain by one at it or at a head within four steps; a relative clause shields."""
        if self.negated_here(i):
            return "negated"
        t, steps = i, 0
        while t >= 0 and steps <= 4:
            near = [t, *self.below.get(t, [])] if steps == 0 else [t, *self.children(t, {"aux", "advmod", "amod", "mark"})]
            if any(self.at[x]["lemma"].lower() in UNCERTAINTY for x in near):
                return "uncertain"
            if self.at[t]["dep"] in ("acl:relcl", "relcl"):
                break
            t, steps = self.at[t]["head_i"], steps + 1
        return "asserted"

    def subjects(self, v: int) -> tuple[list[int], list[int]]:
        """Proteins of a verb's active and passive subjects; a coordinated or complement clause without one takes its head's."""
        active = [p for c in self.children(v, SUBJECTS) for p in self.proteins(c)]
        passive = [p for c in self.children(v, PASSIVE_SUBJECTS) for p in self.proteins(c)]
        own = self.children(v, SUBJECTS | PASSIVE_SUBJECTS)
        n = self.at[v]
        if not own and n["dep"] in ("conj", "xcomp", "advcl") and n["head_i"] >= 0:
            if n["dep"] == "conj" and self.at[n["head_i"]]["pos"] == "VERB":
                return self.subjects(n["head_i"])
            active = self.subjects(n["head_i"])[0]
        if not own and n["dep"] in ("acl:relcl", "relcl", "acl") and n["head_i"] >= 0:
            head = self.proteins(n["head_i"], of=False)
            return ([], head) if n["dep"] == "acl" and n["text"].endswith("ed") else (head, [])
        return active, passive


def events_of(nodes: list[dict]) -> list[dict]:
    s, out, used = Sentence(nodes), [], set()

    def add(channel: str, kind: str, i: int, construction: str, sources: list, targets: list, participants: list, directed: bool, aligned: bool = False, status: str | None = None) -> None:
        out.append({"seq": len(out), "channel": channel, "event_type": kind, "predicate": s.at[i]["lemma"].lower(), "construction": construction, "directed": directed, "aligned": aligned,
                    "assertion_status": status or s.assertion(i), "sources": sources, "targets": targets, "participants": participants})

    for n in nodes:  # clauses
        if n["pos"] != "VERB":
            continue
        v = n["i"]
        active, passive = s.subjects(v)
        phrases = s.children(v, OBLIQUES)
        objects = [p for c in s.children(v, OBJECTS) for p in s.proteins(c)]
        agents = [p for c in phrases if s.case(c) == "by" for p in s.proteins(c)]
        others = [p for c in phrases if s.case(c) not in ("by", "as", "like", "in", "within") for p in s.proteins(c)]
        respectively = any(s.at[c]["lemma"].lower() == "respectively" for c in s.below.get(v, []))
        if passive and agents:
            add("clause", "INTERACTION", v, "passive", agents, passive + others, [], True, respectively)
        elif active and (objects or others):
            add("clause", "INTERACTION", v, "verbal", active, objects + others, [], True, respectively)
        elif passive and others:
            add("clause", "INTERACTION", v, "passive", passive, others, [], True, respectively)
        elif len(set(active)) >= 2 and n["lemma"].lower() in ("interact", "associate", "bind", "dimerize", "colocalize"):
            add("clause", "INTERACTION", v, "reciprocal", [], [], active, False)
        if out and out[-1]["channel"] == "clause" and out[-1]["predicate"] == n["lemma"].lower():
            used.update(c for c in s.children(v, OBJECTS) if s.at[c]["is_nominalized"])
    for n in nodes:  # nominal events
        if n["pos"] not in ("NOUN", "PROPN") or not n["is_nominalized"] or n["i"] in used:
            continue
        i = n["i"]
        by: dict[str, list[int]] = {}
        for c in s.below.get(i, []):
            if s.at[c]["dep"].startswith("nmod") and s.at[c]["dep"] != "nmod:poss":
                by.setdefault(s.case(c), []).extend(s.proteins(c))
        modifiers = [p for c in s.children(i, {"compound", "nmod:poss"}) for p in s.proteins(c)]
        binary = [p for k in BINARY for p in by.get(k, [])]
        if by.get("by") and (by.get("of") or modifiers):
            add("event_nominal", "INTERACTION", i, "nominal", by["by"], by.get("of", []) + modifiers, [], True)
        elif by.get("of") and (modifiers or binary):
            add("event_nominal", "INTERACTION", i, "nominal", modifiers or by["of"], by["of"] if modifiers else binary, [], True)
        elif len(set(modifiers + binary)) >= 2:
            add("event_nominal", "INTERACTION", i, "nominal", [], [], modifiers + binary, False)
    for n in nodes:  # states
        lemma, i = n["lemma"].lower(), n["i"]
        if n["pos"] == "NOUN" and len(lemma) >= 4 and lemma.endswith(("mer", "plex", "gate")) and lemma != "monomer":
            members = s.proteins(i)
            for c in s.below.get(i, []):
                if s.at[c]["dep"].startswith("nmod") and s.case(c) in BINARY | {"of"}:
                    members += [p for p in s.proteins(c) if p not in members]
            if len(set(members)) >= 2:
                add("state", "INTERACTION_STATE", i, "compound_state", [], [], members, False)
    for n in nodes:  # relation statements
        i, head = n["i"], n["head_i"]
        if n["dep"] == "appos" and head >= 0:
            a, b = s.proteins(head, of=False), s.proteins(i)
            if a and b:
                add("relation", "RELATION_STATEMENT", i, "apposition", a, [p for p in b if p not in a], [], True)
        if any(s.at[c]["dep"] == "cop" for c in s.below.get(i, [])) and n["pos"] in ("NOUN", "PROPN"):
            a, b = [p for c in s.children(i, SUBJECTS) for p in s.proteins(c)], s.proteins(i)
            if a and b:
                add("relation", "RELATION_STATEMENT", i, "copula", a, b, [], True)
    return out


def extract_events(sentences: DataFrame) -> DataFrame:
    """A row an event, of sentence_id and nodes; sentences without nodes have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in EVENTS.replace("\n", " ").split(",")]
        for b in batches:
            rows = []
            for sid, nodes in zip(b["sentence_id"], b["nodes"]):
                rows += [{"sentence_id": sid} | e for e in events_of([dict(n) for n in nodes] if nodes is not None else [])]
            yield pd.DataFrame(rows, columns=names)

    return sentences.select("sentence_id", "nodes").mapInPandas(run, EVENTS)


def with_pairs(events: DataFrame) -> DataFrame:
    """Events with the pairs that they are taken for, and why."""
    relational = F.col("event_type") == "RELATION_STATEMENT"
    pairs, reason = projected_pairs(F.col("assertion_status"), relational, F.col("directed"), F.col("sources"), F.col("targets"), F.col("participants"), F.col("aligned"))
    return events.withColumns({"pairs": pairs, "reason": reason})


def predicted_pairs(events: DataFrame) -> DataFrame:
    """sentence_id, a and b of the pairs of all events of a sentence, each once."""
    return with_pairs(events).select("sentence_id", F.inline("pairs")).distinct()


def self_alias_pairs(sentences: DataFrame) -> DataFrame:
    """sentence_id, a and b of proteins with the same name but for case and white space."""
    name = lambda x: F.lower(F.regexp_replace(x, r"\s+", ""))
    named = sentences.select("sentence_id", F.posexplode("proteins").alias("a", "p")).withColumn("p", name(F.col("p")))
    other = named.select("sentence_id", F.col("a").alias("b"), "p")
    return named.join(other, ["sentence_id", "p"]).filter("a < b").select("sentence_id", "a", "b")


def lexical_paths(sentences: DataFrame, pairs: DataFrame, max_hops: int = 8) -> DataFrame:
    """The dependency path of each pair (sentence_id, a, b): its lemmas and dependencies, its apex, and how many edges it has; pairs without a path have none."""
    from .graphs import ancestors, tree_path

    rows = pairs.join(sentences.select("sentence_id", "nodes"), "sentence_id")
    place = lambda p: F.array_position(F.transform("nodes", lambda n: n["text"]), F.concat(F.lit("PROTEIN"), p.cast("string"))).cast("int") - 1
    heads = F.transform("nodes", lambda n: n["head_i"])
    rows = rows.withColumns({"_u": F.when(place(F.col("a")) >= 0, ancestors(heads, place(F.col("a")))), "_v": F.when(place(F.col("b")) >= 0, ancestors(heads, place(F.col("b"))))})
    rows = rows.withColumn("_path", tree_path(F.col("_u"), F.col("_v"), max_hops)).filter(F.size("_path") > 0)
    node = lambda i: F.get(F.col("nodes"), i)
    apex = F.get(F.filter("_u", lambda x: F.array_contains("_v", x)), F.lit(0))
    return rows.select(
        "sentence_id", "a", "b", (F.size("_path") - 1).alias("hops"), node(apex)["lemma"].alias("apex"),
        F.array_join(F.transform("_path", lambda i: node(i)["lemma"]), " ").alias("lemmas"),
        F.array_join(F.transform(F.filter("_path", lambda i: i != apex), lambda i: node(i)["dep"]), " ").alias("deps"),
    )
