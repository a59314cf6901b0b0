"""Variant spellings of names: trie join with Levenshtein automata, then token-order permutations.

The authority names are dealt out in shards of at most SHARD_ENTITIES; the words of a shard form tries, one per kind and
script.  Every spelling meets every shard, each pair of a shard and a share of the spellings in a task of its own.  A
word of a typed name walks the trie with the rows of a Levenshtein automaton (a swap of neighbours counts once) and so
meets every listed word within its bounded distance; initials and words cut short meet the words they begin, nicknames
the names they stand for.  What two entities share does not decide: the words of the typed name are assigned to the
words of an entity in any order, each at most once, by a search over all orders, and every word must find its place.  A
person needs the surname and a given name or initial that agree; an organisation all its own words, its type may be
abbreviated or missing; a work all its words and its number.  The entity with the fewest edits over all shards wins; if
two win, the name is linked to none.

A name in Latin letters is also compared with the listed names of Cyrillic spelling in a common transliteration.

Typed names are compared once per spelling.  No list is sent to all tasks, and neither list nor names have a bound.

Defined results: null and blank names have no entity; an exact match is linked like any other (distance 0, variant
false); ties give no link; listed names without an id or a name are left out; repeated rows are linked as often as they
occur; extra columns are ignored; an empty table gives an empty result, an empty authority list no links.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.llm.confusables import tidy
from tomeforge.operators.skew import salted_join
from tomeforge.runtime import table

# Transliteration, short forms, words that belong to an edition and not to a title.
LETTERS = dict(zip("абвгдезийклмнопрстуфыэәғқңөұүһі", "abvgdeziyklmnoprstufyeagqnouuhi")) | {
    "ё": "e", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ь": "", "ю": "yu", "я": "ya", "җ": "j",
}
NICKNAMES = {
    "алеша": "алексей", "леша": "алексей", "саша": "александр", "аня": "анна", "варя": "варвара", "вова": "владимир", "володя": "владимир",
    "гриша": "григорий", "дима": "дмитрий", "митя": "дмитрий", "катя": "екатерина", "лена": "елена", "ира": "ирина", "лида": "лидия",
    "маша": "мария", "миша": "михаил", "наташа": "наталья", "коля": "николай", "оля": "ольга", "паша": "павел", "родя": "родион",
    "сережа": "сергей", "соня": "софья", "таня": "татьяна", "тима": "тимофей", "тимоша": "тимофей", "федя": "федор", "глаша": "глафира", "петя": "петр",
    "bill": "william", "will": "william", "bob": "robert", "rob": "robert", "charlie": "charles", "dick": "richard", "rick": "richard", "ned": "edward",
    "ted": "edward", "tom": "thomas", "harry": "henry", "hal": "henry", "kate": "catherine", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth",
    "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "dot": "dorothy", "dolly": "dorothy", "sue": "susan", "judy": "judith", "flo": "florence",
    "winnie": "winifred", "hattie": "harriet", "aggie": "agnes", "gil": "gilbert", "bert": "gilbert", "wally": "walter", "walt": "walter", "jim": "james", "jack": "john",
}
ORG_TYPES = {"типография", "издательство", "институт", "баспа", "институты", "нәшрият", "җәмгыять", "press", "institute", "workshop", "society", "publishers", "house", "қоғам", "қоғамы", "общество", "мастерская", "foundation", "фонд"}
SHORT = {"изд": "издательство", "издво": "издательство", "тип": "типография", "типогр": "типография", "инт": "институт", "ин": "институт", "инст": "институт", "pr": "press", "inst": "institute", "soc": "society", "fdn": "foundation", "б": "баспа", "нәшр": "нәшрият", "җәмг": "җәмгыять"}
HONORIFICS = {"dr", "prof", "mr", "mrs", "ms", "sir", "rev", "проф", "акад", "доц"}
ARTICLES = {"the", "a", "an"}
SUBTITLE = re.compile(r"\s*[:;,]\s*(?![ivx]+\s*$)[^:;,]*$", re.IGNORECASE)
EDITION = re.compile(r"\((?:[^()]*(?:изд|испр|доп|ed\.|edition|rev|бас|нче бас)[^()]*)\)|\[[^\]]*\]|[.,]?\s*(?:избранное|таңдамалы|сайланма|selected)\s*$", re.IGNORECASE)
ROMAN = re.compile(r"[ivx]+")
WORD = re.compile(r"[^\W_]+\.?")


def fold(text: str) -> str:
    return tidy(text).lower().replace("ё", "е")


@lru_cache(maxsize=200_000)
def latin(word: str) -> str:
    return "".join(LETTERS.get(c, c) for c in word)


#: Entities of one shard; spellings that meet a shard in one task.
SHARD_ENTITIES = 20_000
SPELLINGS = 20_000
#: Edits a whole name may have.
MOST_EDITS = 2


def edits_allowed(n: int) -> int:
    return 0 if n < 4 else 1 if n < 8 else 2


class Trie:
    """Words with their payload; near() walks it with the rows of a Levenshtein automaton."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = word

    def near(self, word: str, most: int) -> dict[str, int]:
        """Listed words within `most` edits, with their distance."""
        found: dict[str, int] = {}
        stack = [(node, c, list(range(len(word) + 1)), None, "") for c, node in self.root.items() if c]
        while stack:
            node, c, row, older, parent = stack.pop()
            new = [row[0] + 1]
            for i, w in enumerate(word, 1):
                d = min(new[i - 1] + 1, row[i] + 1, row[i - 1] + (w != c))
                if older is not None and i > 1 and w == parent and word[i - 2] == c:
                    d = min(d, older[i - 2] + 1)
                new.append(d)
            if "" in node and new[-1] <= most:
                found[node[""]] = new[-1]
            if min(new) <= most or min(row) < most:
                stack += [(child, k, new, row, c) for k, child in node.items() if k]
        return found

    def beginning(self, prefix: str) -> list[str]:
        node = self.root
        for c in prefix:
            node = node.get(c)
            if node is None:
                return []
        found, stack = [], [node]
        while stack:
            node = stack.pop()
            for k, child in node.items():
                if k:
                    stack.append(child)
                else:
                    found.append(child)
        return found


class Shard:
    """The entities of one kind in one script, by their words."""

    def __init__(self) -> None:
        self.trie, self.where, self.words = Trie(), defaultdict(set), {}
        self.near = lru_cache(maxsize=100_000)(self._near)

    def add(self, entity: int, words: list[str]) -> None:
        self.words[entity] = words
        for w in words:
            if w not in self.where:
                self.trie.add(w)
            self.where[w].add(entity)

    def _near(self, word: str, dotted: bool) -> tuple[tuple[str, int], ...]:
        found = self.trie.near(word, edits_allowed(len(word)))
        if dotted and len(word) >= 2:
            for w in self.trie.beginning(word):
                found.setdefault(w, 0)
        return tuple(found.items())


def _split(text: str) -> list[tuple[str, bool]]:
    """(word, ends with a dot) of a folded name."""
    return [(w.rstrip("."), w.endswith(".")) for w in WORD.findall(text)]


def fewest_edits(target: list[str], options: list[dict[str, int]], must: list[str], most: int = MOST_EDITS) -> int | None:
    """Fewest edits, up to `most`, with which each word finds a place of its own among the target's words, in any order.

    options: per word the target's words it may stand for, with the edits; must: words of the target that have to be
    found. Equal words of the target are interchangeable, so orders that differ only in them are tried once.
    """
    if len(options) > len(target):
        return None
    words = sorted(set(target))
    count, needed = Counter(target), Counter(must)
    fits = sorted(([(opts[w], k) for k, w in enumerate(words) if w in opts] for opts in options), key=len)
    best: dict[tuple, int | None] = {}

    def search(at: int, free: tuple[int, ...], left: int) -> int | None:
        if at == len(fits):
            found = all(count[w] - free[k] >= needed[w] for k, w in enumerate(words))
            return 0 if found else None
        if (at, free, left) not in best:
            costs = []
            for cost, k in fits[at]:
                if free[k] and cost <= left:
                    rest = search(at + 1, free[:k] + (free[k] - 1,) + free[k + 1 :], left - cost)
                    if rest is not None:
                        costs.append(cost + rest)
            best[at, free, left] = min(costs, default=None)
        return best[at, free, left]

    return search(0, tuple(count[w] for w in words), most)


#: How a name was found, best first; of each kind only the best way counts.
EXACT, OWN, OWN_LOOSE, LATIN, LATIN_LOOSE = range(5)


class Linker:
    """Links spellings to the entities of one shard."""

    def __init__(self, authority: list[tuple[int, str, str]]):
        self.exact: dict[tuple[str, str], set[int]] = defaultdict(set)
        self.shards = {(k, s): Shard() for k in ("person", "organisation", "work") for s in ("own", "latin")}
        for e, kind, name in authority:
            if (kind, "own") not in self.shards:
                continue
            words = [w for w, _ in _split(fold(name)) if kind != "work" or w not in ARTICLES]
            self.exact[kind, name].add(e)
            if not words:
                continue
            self.shards[kind, "own"].add(e, words)
            if any("Ѐ" <= c <= "ԯ" for c in name):
                self.shards[kind, "latin"].add(e, [latin(w) or w for w in words])

    def _person(self, text: str, script: str) -> list[tuple[bool, int, int]]:
        shard = self.shards["person", script]
        text = re.sub(r"(?<=[^\W\d_]{3}),(?=[^\W\d_]\b)", "", text)  # a comma that slipped into a word
        words = [(w, d) for w, d in _split(text) if w not in HONORIFICS]
        if len(words) < 2:
            return []
        options, entities = [], defaultdict(int)
        for word, dotted in words:
            initial = len(word) == 1 or script == "latin" and len(word) <= 3 and dotted
            if initial:
                opts = {w: 0 for w in shard.trie.beginning(word)}
            else:
                opts = {w: d for w, d in shard.near(word, False) if d <= 1}
                nick = NICKNAMES.get(word)
                if nick in shard.where:
                    opts[nick] = 0
                if script == "latin":
                    for short, full in NICKNAMES.items():
                        if latin(short) == word and latin(full) in shard.where:
                            opts[latin(full)] = 0
            options.append(opts)
            for w in opts:
                if not initial:
                    for e in shard.where[w]:
                        entities[e] += 1
        found = []
        for e in entities:
            target = shard.words[e]
            if any(len(w) > 1 and target[-1] in o for (w, _), o in zip(words, options)):  # the surname, not its initial
                cost = fewest_edits(target, options, [target[0], target[-1]] if len(target) > 1 else target)
                if cost is not None:
                    found.append((False, cost, e))
        return found

    def _organisation(self, text: str, script: str) -> list[tuple[bool, int, int]]:
        shard = self.shards["organisation", script]
        kinds = ORG_TYPES if script == "own" else {latin(x) for x in ORG_TYPES}
        words = [(SHORT.get(w, w) if d or w in SHORT and w not in ("ин", "б") else w, d) for w, d in _split(re.sub(r"(?<=изд)-(?=во)|(?<=ин)-(?=т)", "", text))]
        own = [(w, d) for w, d in words if w not in kinds]
        if script == "latin":
            own = [(w, d) for w, d in own if latin(SHORT.get(w, "")) not in kinds]
        if not own:
            return []
        options = [dict(shard.near(w, d)) for w, d in own]
        entities = set().union(*(shard.where[w] for o in options for w in o)) if any(options) else set()
        found = []
        for e in entities:
            target = shard.words[e]
            cost = fewest_edits(target, options, [w for w in target if w not in kinds])
            if cost is not None:
                typed = {w for w, _ in words if w in kinds}
                listed = {w for w in target if w in kinds}
                if not typed or not listed or any(a == b or b.startswith(a) or a.startswith(b) for a in typed for b in listed):
                    found.append((False, cost, e))
        if not found:  # the type itself may be misspelt
            options = [dict(shard.near(w, d)) for w, d in words]
            for e in entities:
                cost = fewest_edits(shard.words[e], options, shard.words[e])
                if cost is not None:
                    found.append((True, cost, e))
        return found

    def _work(self, text: str, script: str) -> list[tuple[bool, int, int]]:
        text = EDITION.sub(" ", text).replace("_", " ")
        found = [(False, *x) for x in self._title(_split(text), script)]
        if not found and SUBTITLE.search(text):  # the whole with a subtitle of its own is no listed title
            found = [(True, *x) for x in self._title(_split(SUBTITLE.sub("", text)), script)]
        return found

    def _title(self, words: list[tuple[str, bool]], script: str) -> list[tuple[int, int]]:
        shard = self.shards["work", script]
        words = [(w, d) for w, d in words if w not in ARTICLES]
        if not words:
            return []
        options = []
        for w, d in words:
            opts = {w: 0} if ROMAN.fullmatch(w) and w in shard.where else {} if ROMAN.fullmatch(w) and len(w) > 0 and script == "own" and w not in shard.where else dict(shard.near(w, d and len(w) >= 3))
            options.append(opts)
        if not all(options):
            return []
        rare = min(options, key=lambda o: sum(len(shard.where[w]) for w in o))
        found = []
        for e in set().union(*(shard.where[w] for w in rare)):
            target = shard.words[e]
            cost = fewest_edits(target, options, target)
            if cost is not None:
                found.append((cost, e))
        return found

    def link(self, field: str, name: str | None) -> tuple[int, int, set[int]] | None:
        """(way, edits, entities) of the best way in which the name means entities of this shard."""
        if not name or not name.strip():
            return None
        kinds = ("person", "organisation") if field == "author" else ("work",)
        exact = set().union(*(self.exact.get((k, name), set()) for k in kinds))
        if exact:
            return EXACT, 0, exact
        text = fold(name)
        for script in ("own", "latin"):
            if script == "latin" and any("Ѐ" <= c <= "ԯ" for c in text):
                continue
            found: list[tuple[bool, int, int]] = []
            for k in kinds:
                found += {"person": self._person, "organisation": self._organisation, "work": self._work}[k](text, script)
            if found:
                loose, edits, _ = min(found)
                return (OWN if script == "own" else LATIN) + loose, edits, {e for x, d, e in found if (x, d) == (loose, edits)}
        return None


def link_names(spellings: DataFrame, authority: DataFrame, shard_entities: int = SHARD_ENTITIES) -> DataFrame:
    """spellings: (field, name).  Returns (field, name, entity_id, edits, variant) of every linked spelling, each once."""
    spark = spellings.sparkSession
    listed = authority.where(F.col("name").isNotNull() & F.col("entity_id").isNotNull()).select("entity_id", "kind", "name").distinct()
    names = spellings.where(F.col("name").isNotNull()).select("field", "name").distinct()
    shards = max(1, -(-listed.count() // shard_entities))
    # the few bytes of a spelling cost much work, which sizes do not show: the number of partitions is given
    width = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = max(-(-width // shards), -(-names.count() // SPELLINGS))
    left = names.withColumn("share", F.pmod(F.xxhash64("name"), F.lit(shares)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = listed.withColumn("shard", F.pmod(F.xxhash64("entity_id"), F.lit(shards)).cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    def run(rows: pd.DataFrame, entities: pd.DataFrame) -> pd.DataFrame:
        out = []
        linker = Linker(list(zip(entities["entity_id"].tolist(), entities["kind"], entities["name"]))) if len(rows) else None
        for field, name in zip(rows["field"], rows["name"]):
            found = linker.link(field, name)
            if found:
                way, edits, winners = found
                out.append((field, name, way * 100 + edits, len(winners), min(winners)))
        return pd.DataFrame(out, columns=["field", "name", "cost", "winners", "entity_id"]).astype({"cost": "int32", "winners": "int32", "entity_id": "int64"})

    keys = ["shard", "share"]
    met = left.repartition(width, *keys).groupBy(*keys).cogroup(right.repartition(width, *keys).groupBy(*keys)).applyInPandas(run, "field string, name string, cost int, winners int, entity_id long")
    best = met.groupBy("field", "name").agg(F.min(F.struct("cost", "entity_id")).alias("b"), F.collect_list(F.struct("cost", "winners")).alias("all"))  # a row per shard at most
    winners = F.aggregate(F.filter("all", lambda x: x["cost"] == F.col("b.cost")), F.lit(0), lambda n, x: n + x["winners"])
    return best.where(winners == 1).select("field", "name", F.col("b.entity_id").alias("entity_id"), (F.col("b.cost") % 100).cast("long").alias("edits"), (F.col("b.cost") >= 100).alias("variant"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = table(spark, sf_dir, "books", ["id", "author", "title"])
    fields = books.select("id", F.explode(F.array(F.struct(F.lit("author").alias("field"), F.col("author").alias("name")), F.struct(F.lit("title").alias("field"), F.col("title").alias("name")))).alias("f")).select("id", "f.*")
    return salted_join(fields, link_names(fields, table(spark, sf_dir, "authority_names")), ["field", "name"])  # one spelling may be that of very many books


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).where("variant").select(F.col("id").alias("book_id"), "entity_id").distinct()


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select(F.col("id").alias("book_id"), "field", "entity_id", "edits", "variant")


QUERIES = {"p4_found": p4_found, "p4_links": p4_links}
