"""Right-to-left analysis of words: a graph of word states, affixes that act on the stem before them, and roots of any number.

A search reads a word from its end. Each affix whose form ends the rest leads along the arcs of the graph that its attributes satisfy, and gives the
stems from which its action makes what stands before the form: all edits of that text are tried, and those kept that the action turns back
into it. What may be a root at some point is looked up by a join, so that only the affixes, a closed class, travel to the workers.

Words are in the simplified orthography (N for ng).
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Arcs of the word graph: state, condition (- where there is none), state. 0 is the beginning of a word.
ARCS = """
w id:guuq/1q wt | w id:kia/1q wt | w id:ttauq/1q wt | w id:qai/1q wt | w type:q wnt | w - wnt
wt id:li/1q wnt | wt id:lu/1q wnt
wnt - n | wnt - v | wnt - e | wnt - a | wnt - c | wnt - pp | wnt - d | wnt - ns
n type:tn ns | n type:tn nsc | n type:n,number:d 0 | n type:n,number:p 0 | n type:tn,number:s,possPers:null a
v type:tv rv
a type:a 0
e type:e 0
c type:c 0
ns function:nn ns | ns function:nn nsc | ns function:nn a | ns function:vn a | ns function:vn rv | ns type:n,number:s 0 | ns type:p,!nature:per 0
nsc type:n,subtype:nc 0
rv function:vv rv | rv function:nv n | rv function:nv ns | rv function:nv nsc | rv function:nv a | rv function:nv d | rv type:v 0
d type:ad 0 | d type:pd 0 | d type:tad ad | d type:tpd,number:s pds | d type:tpd,number:p pdp
ad type:rad 0
pds type:rpd,number:s 0
pdp type:rpd,number:p 0
pp - pp12 | pp - pps12 | pp - pps | pp type:tn,possPers:null pps
pp12 function:nn pps12 | pp12 function:nn pp12
pps12 type:tn,possPers:1,possNumber:Xnumber ppr1 | pps12 type:tn,possPers:2,possNumber:Xnumber ppr2
pps type:p 0 | pps function:nn pps
ppr1 id:uva/1rpr 0
ppr2 id:ili/1rp 0
"""
VOWELS = "aiu"
#: Voiced and nasal counterparts of the consonants.
VOICED, NASAL = dict(zip("ptkq", "vlgr", strict=True)), dict(zip("ptkq", "mnNr", strict=True))


def arcs() -> list[tuple[str, str | None, str]]:
    return [(a, None if c == "-" else c, b) for line in ARCS.strip().splitlines() for a, c, b in (x.split() for x in line.split("|"))]


def closed_arcs(given: list[tuple[str, str | None, str]] | None = None) -> dict[str, list[tuple[str, str]]]:
    """state -> (condition, state) of every arc with a condition that it reaches over arcs without."""
    own = arcs() if given is None else given
    out: dict[str, list[tuple[str, str]]] = {}
    for start in {a for a, _, _ in own}:
        seen, todo = {start}, [start]
        while todo:
            at = todo.pop()
            for a, c, b in own:
                if a == at and c is None and b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[start] = [(c, b) for a, c, b in own if a in seen and c is not None]
    return out


#: One state in which any order of affixes is allowed.
ANY_ORDER = {"w": [("", "w"), ("root:1", "0")]}


def holds(condition: str | None, attrs: dict[str, str | None]) -> bool:
    """A condition on a morpheme's attributes: commas and, blanks or, ! not, attr:val membership, attr:null, attr:Xother the value of another."""
    if not condition:
        return True

    def one(term: str) -> bool:
        wanted = not term.startswith("!")
        name, _, value = term.lstrip("!").partition(":")
        have = attrs.get(name)
        if value == "null":
            got = have is None
        else:
            value = attrs.get(value[1:]) if value.startswith("X") else value
            got = have is not None and value in have.split(" ")
        return got is wanted

    return any(all(one(t) for t in part.split(",")) for part in condition.split(" "))


def attributes(canonical: str, identifier: str) -> dict[str, str | None]:
    """What an id says of its morpheme: endings as tn-case-number-possessor and tv-mood-subject-object, suffixes as 1vv, roots as 1n."""
    out: dict[str, str | None] = {"id": f"{canonical}/{identifier}"}
    parts = identifier.split("-")
    if len(parts) > 1:
        out |= {"type": parts[0], "case": parts[1], "number": parts[2][-1] if len(parts) > 2 and parts[2] else None}
        if len(parts) > 3:
            out |= {"possPers": parts[3][0], "possNumber": parts[3][-1]}
        return out
    kind = identifier.lstrip("0123456789")
    if re.fullmatch("[nv]{2}", kind):
        return out | {"type": "sv" if kind[0] == "v" else "sn", "function": kind}
    return out | {"type": kind, "number": "s", "root": "1"}


@dataclass(frozen=True)
class Behaviour:
    """A surface form, the end of stem that it asks for (V, t, k, q, C or empty for any) and what it does to the stem."""

    form: str
    context: str = ""
    action: str = "keep"
    second: str = ""


@dataclass(frozen=True)
class Affix:
    canonical: str
    identifier: str
    behaviours: tuple[Behaviour, ...]
    #: What the morpheme before it must satisfy.
    before: str | None = None
    attrs: dict[str, str | None] = field(default_factory=dict, compare=False, hash=False)


def _second(stem: str, action: str) -> str | None:
    """The second action, on a stem that ends in two vowels after the first."""
    if not action or len(stem) < 2 or stem[-1] not in VOWELS or stem[-2] not in VOWELS:
        return stem
    if action.startswith("ins("):
        return stem + action[4:-1]
    if action.startswith("drop("):
        return stem[:-1] if stem[-1] == action[5:-1] else stem
    return stem[:-1] if action == "drop" else stem


def acted(stem: str, behaviour: Behaviour) -> str | None:
    """stem after the affix has acted on it, None where the behaviour doesn't apply. keep leaves it, drop takes the last consonant (in a context
    of vowels the last vowel), dropl the last letter, voice and nasal change the last consonant, ins(x) adds x, dropins(x) puts x for the last consonant,
    assim(x) turns the last consonant into x, vdup doubles the last vowel, gem the last consonant, dropvdup drops a consonant and doubles the vowel.
    """
    last = stem[-1:]
    vowel = last in VOWELS
    context, action = behaviour.context, behaviour.action
    if not last or context == "V" and not vowel or context == "C" and vowel or context in ("t", "k", "q") and last != context:
        return None
    inner = action[action.find("(") + 1 : -1] if action.endswith(")") else ""
    name = action.partition("(")[0]
    if name in ("keep", ""):
        out = stem
    elif name == "dropl":
        out = stem[:-1]
    elif name == "drop":
        out = stem[:-1] if not vowel or context == "V" else None
    elif name == "dropv":
        out = stem[:-1] if vowel else None
    elif name == "voice":
        out = stem[:-1] + VOICED[last] if last in VOICED else None
    elif name == "nasal":
        out = stem[:-1] + NASAL[last] if last in NASAL else None
    elif name == "ins":
        out = stem + inner
    elif name == "dropins":
        out = stem[:-1] + inner if not vowel else None
    elif name == "assim":
        out = stem[:-1] + (inner or behaviour.form[:1]) if not vowel else None
    elif name == "vdup":
        out = stem + last if vowel else None
    elif name == "gem":
        out = stem + last if not vowel else None
    elif name == "dropvdup":
        out = stem[:-1] + stem[-2] if not vowel and stem[-2:-1] in VOWELS else None
    else:
        out = None
    return None if out is None else _second(out, behaviour.second)


def stems_before(shown: str, behaviour: Behaviour) -> list[str]:
    """All stems that the behaviour turns into shown, the shortest edits first."""
    ends = ["", *"aiuptkqgmnNsljvr", *(v + c for v in VOWELS for c in "tkq")]
    inner = len(re.sub(r"[a-z]*\(|\)", "", behaviour.action)) if "(" in behaviour.action else 0
    tried = dict.fromkeys(shown[: len(shown) - cut] + end for cut in range(min(max(2, inner + 1), len(shown)) + 1) for end in ends)
    return [s for s in tried if s and acted(s, behaviour) == shown]


class Analyzer:
    """Searches of words over a closed class of affixes."""

    def __init__(self, affixes: list[Affix], graph: dict[str, list[tuple[str, str]]] | None = None, most_affixes: int = 12) -> None:
        self.graph = closed_arcs() if graph is None else graph
        self.most = most_affixes
        self.forms: dict[str, list[tuple[Affix, Behaviour, dict]]] = {}
        for a in affixes:
            attrs = a.attrs or attributes(a.canonical, a.identifier)
            for b in a.behaviours:
                self.forms.setdefault(b.form, []).append((a, b, attrs))
        self.longest = max(map(len, self.forms), default=0)
        self.known: dict[tuple[str, Behaviour], list[str]] = {}

    def _before(self, shown: str, b: Behaviour) -> list[str]:
        key = (shown[-4:], b)
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            # Edits reach no further than the last letters.
            self.known[key] = [s for s in stems_before(shown[-4:], b)]
        return [shown[:-4] + s for s in self.known[key]]

    def stems(self, word: str, seconds: float | None = None) -> Iterator[tuple[str, str, tuple[str, ...]]]:
        """(stem, conditions, parts) of every way to read word: the conditions (joined by blanks) of which a root must satisfy one, and the parts after it.

        A root doesn't end the search. An affix doesn't follow itself. TimeoutError after seconds.
        """
        end = None if seconds is None else time.monotonic() + seconds
        todo: list[tuple[str, frozenset[str], tuple[str, ...], Affix | None, str | None, str]] = [(word, frozenset("w"), (), None, None, word)]
        while todo:
            rest, states, tail, after, wanted, shown = todo.pop()
            if end is not None and time.monotonic() > end:
                raise TimeoutError(word)
            conditions = {c for s in states for c, to in self.graph.get(s, ()) if to == "0"}
            if conditions:
                yield rest, "|".join(sorted(conditions)), (f"{{{shown}:", wanted or "", *tail)
            if len(tail) >= self.most:
                continue
            for k in range(1, min(self.longest, len(rest) - 1) + 1):
                for affix, b, attrs in self.forms.get(rest[-k:], ()):
                    if affix is after or not holds(wanted, attrs):
                        continue
                    to = frozenset(t for s in states for c, t in self.graph.get(s, ()) if t != "0" and holds(c, attrs))
                    if not to:
                        continue
                    # The surface of an affix is what is left of it before the next one.
                    surface = shown[len(rest) - k :] if len(shown) >= len(rest) - k else rest[-k:]
                    part = f"{{{surface}:{affix.canonical}/{affix.identifier}}}"
                    for stem in self._before(rest[:-k], b):
                        todo.append((stem, to, (part, *tail), affix, affix.before, rest[:-k]))


    def first(self, word: str, roots: dict[str, list[str]], most: int | None = None, seconds: float | None = None) -> list[str]:
        """Distinct analyses of one word over a small lexicon (canonical -> ids), at most most: the search ends when there are so many."""
        found: dict[str, None] = {}
        for stem, conditions, (shown, wanted, *tail) in self.stems(word, seconds):
            for identifier in roots.get(stem, ()):
                attrs = attributes(stem, identifier)
                if holds(wanted, attrs) and any(holds(c, attrs) for c in conditions.split("|")):
                    found.setdefault(f"{shown}{stem}/{identifier}}}{''.join(tail)}")
                    if most is not None and len(found) >= most:
                        return list(found)
        return list(found)


def seeds(word: str, lenient: bool) -> list[tuple[str, bool]]:
    """The forms in which a word is searched, and whether a form is a lenient one: a final n may stand for t, and after a final vowel a
    consonant may be missing.
    """
    out = [(word, False)]
    if word.endswith("n"):
        out.append((word[:-1] + "t", False))
    if lenient and word[-1:] in VOWELS and word:
        out += [(word + c, True) for c in "tkq"]
    return out


def analyses(words: DataFrame, roots: DataFrame, affixes: list[Affix], graph: dict[str, list[tuple[str, str]]] | None = None, lenient: bool = False, seconds: float | None = None) -> DataFrame:
    """(word, status, decomps, lenients) of each distinct word: completed, timed_out or crashed, with its analyses over roots (canonical, identifier):
    strict ones before lenient ones, then by longer root, fewer parts and text; each once.

    Null and empty words are left out. Roots are joined to the stems that the search finds and may be of any number; affixes are a closed class of a
    few thousand at most.
    """
    shared = words.sparkSession.sparkContext.broadcast((affixes, graph))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Analyzer(*shared.value)
        for b in batches:
            status, lists = [], []
            for w in b.column(0).to_pylist():
                got: list[dict] = []
                state = "completed"
                try:
                    for form, loose in seeds(w, lenient):
                        for stem, conditions, (shown, wanted, *tail) in search.stems(form, seconds):
                            text = "".join(tail)
                            got.append({"stem": stem, "conditions": conditions, "wanted": wanted, "shown": shown, "tail": text, "parts": len(tail), "loose": loose})
                except TimeoutError:
                    got, state = [], "timed_out"
                except Exception:  # noqa: BLE001
                    got, state = [], "crashed"
                status.append(state)
                lists.append(got)
            kind = pa.struct([("stem", pa.string()), ("conditions", pa.string()), ("wanted", pa.string()), ("shown", pa.string()), ("tail", pa.string()), ("parts", pa.int32()), ("loose", pa.bool_())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(status, pa.string()), pa.array(lists, pa.list_(kind))], ["word", "status", "stems"])

    stem = "struct<stem:string,conditions:string,wanted:string,shown:string,tail:string,parts:int,loose:boolean>"
    rows = words.select("word").where("word IS NOT NULL AND word <> ''").distinct().mapInArrow(run, f"word string, status string, stems array<{stem}>")
    rows = rows.select("word", "status", F.explode_outer("stems").alias("s")).select("word", "status", "s.*")
    lexicon = roots.select("canonical", "identifier").distinct()
    rows = rows.join(lexicon, F.col("stem") == F.col("canonical"), "left")
    # What an id says of a root is enough for the conditions of the graph: type, number and id.
    kind = F.regexp_replace("identifier", "^[0-9]+", "")
    terms = {"type:": kind, "number:": F.lit("s"), "id:": F.concat_ws("/", "canonical", "identifier"), "root:": F.lit("1")}
    term = lambda t: F.coalesce(*(F.when(t.startswith(p), F.substring(t, len(p) + 1, 10**6) == v) for p, v in terms.items()), F.lit(False))
    signed = lambda t: F.when(t.startswith("!"), ~term(F.substring(t, 2, 10**6))).otherwise(term(t))
    fits = F.exists(F.split("conditions", r"\|"), lambda c: F.forall(F.split(c, ","), signed))
    asked = (F.col("wanted") == "") | F.exists(F.split("wanted", " "), lambda c: F.forall(F.split(c, ","), signed))
    text = F.concat("shown", "canonical", F.lit("/"), "identifier", F.lit("}"), "tail")
    found = F.when(F.col("canonical").isNotNull() & fits & asked, F.struct(F.col("loose").cast("int").alias("loose"), (-F.length("canonical")).alias("root"), "parts", text.alias("text")))
    out = rows.groupBy("word").agg(F.first("status").alias("status"), F.sort_array(F.collect_set(found)).alias("x"))
    # The first of each text, whether strict or lenient.
    kept = F.expr("filter(x, (y, i) -> NOT exists(slice(x, 1, i), z -> z.text = y.text))")
    out = out.withColumn("x", kept)
    return out.select("word", "status", F.col("x.text").alias("decomps"), F.transform("x", lambda y: y["loose"] == 1).alias("lenients"))


def collapsed(rows: DataFrame, composites: DataFrame) -> DataFrame:
    """rows (word_id, cand_id, keys) without those that spell a composite out: keys contain the parts of a composite (id, parts) side by side, and another
    row of the word has the same keys with the composite's id in their place. Rows and composites are joined by the first part.
    """
    joined = F.array_join("keys", "|")
    parts = composites.where("size(parts) > 0").select(F.col("id").alias("__id"), "parts", F.get("parts", F.lit(0)).alias("__first")).distinct()
    at = rows.select("word_id", "cand_id", "keys", F.posexplode("keys").alias("pos", "__first")).join(parts, "__first").where(F.expr("slice(keys, pos + 1, size(parts)) = parts"))
    other = F.expr("concat(slice(keys, 1, pos), array(__id), slice(keys, pos + size(parts) + 1, size(keys)))")
    at = at.select("word_id", "cand_id", "keys", other.alias("other")).where("other <> keys").select("word_id", "cand_id", F.array_join("other", "|").alias("text"))
    have = rows.select("word_id", joined.alias("text")).distinct()
    return rows.join(at.join(have, ["word_id", "text"], "left_semi").select("cand_id").distinct(), "cand_id", "left_anti")
