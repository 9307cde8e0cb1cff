"""Dictionaries of words and phrases, found in texts by hash.

Terms are filed under a hash of their first word, as in a trie whose root is a
hash table: at each place of a text only the terms that begin like the word
there are looked at, so that the cost of a text doesn't grow with the number of
terms. Stems are filed under the stem, and a word asks for each of its fronts.
The tables are constants of the plan.

A term is one or more words. Latin words stand whole, the last with or without a
plural's ending; each Cyrillic word is the front of one. A word with "!" behind
it stands exactly as it is, one in slashes is an expression for a whole word
(not the first of a term).
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

CYRILLIC = re.compile("[Ѐ-ӿ]")
#: Marks behind a word: any ending, a plural's ending.
FRONT, PLURAL, SHAPE = "*", "+", "/"


def plain(text: Column) -> Column:
    """Lower case, letters and digits only, one space between words."""
    low = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ё"), F.lit("е"))
    return F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))


def constant(values: Sequence[object], kind: str = "string") -> Column:
    """An array as a constant that the optimizer works out once. Values hold
    no "|"."""
    return F.split(F.lit("|".join(str(v) for v in values)), "[|]").cast(f"array<{kind}>")


def looked_up(word: Column, table: dict[str, str]) -> Column:
    """What a table says of a word, found by hash; null if it has none. Words
    hold no space and values no space or "="."""
    slots = 1 << max(4, (2 * len(table)).bit_length())
    filed = defaultdict(list)
    for key, value in table.items():
        filed[zlib.crc32(key.encode()) % slots].append(f"{key}={value}")
    bucket = F.get(constant([" ".join(filed[s]) for s in range(slots)]), (F.crc32(word.cast("binary")) % slots).cast("int"))
    return let(bucket, lambda b: F.when(b != "", F.try_element_at(F.str_to_map(b, F.lit(" "), F.lit("=")), word)))


def parsed(term: str, plurals: bool = True) -> list[str]:
    """The words of a term, each with its mark."""
    stems, words = bool(CYRILLIC.search(term)), []
    for token in term.lower().replace("ё", "е").split():
        if token.startswith("/"):
            words.append(token.rstrip("/"))
            continue
        parts = [w for w in re.split(r"[^\w]+|_", token.rstrip("!")) if w]
        words += [p + (FRONT if stems else "") for p in parts[:-1]]
        words.append(parts[-1] + ("" if token.endswith("!") else FRONT if stems else PLURAL if plurals else ""))
    # Only the last Latin word takes an ending.
    return [w.rstrip(PLURAL) for w in words[:-1]] + words[-1:]


class Terms:
    """Terms to look for, numbered from 0. With `plurals` off, Latin words
    stand exactly."""

    def __init__(self, terms: Sequence[str], plurals: bool = True) -> None:
        self.words = [parsed(t, plurals) for t in terms]
        if any(w[0].startswith(SHAPE) for w in self.words):
            raise ValueError("a term can't begin with an expression")
        #: Characters of a term, by which the longer of two is told.
        self.lengths = [len(" ".join(x.strip("*+/") for x in w)) for w in self.words]
        self.slots = 1 << max(4, (2 * len(self.words)).bit_length())
        filed = defaultdict(list)
        for n, words in enumerate(self.words):
            filed[zlib.crc32(words[0].rstrip("*+").encode()) % self.slots].append(n)
        self._filed = constant([" ".join(map(str, filed[s])) for s in range(self.slots)])
        self._words = constant([" ".join(w) for w in self.words] or [""])
        self._stems = any(w[0].endswith(FRONT) for w in self.words)

    def _near(self, word: Column) -> Column:
        """Numbers of the terms that may begin with a word."""
        front = lambda n: F.substr(word, F.lit(1), n)
        fronts = F.transform(F.sequence(F.lit(1), F.length(word)), front)
        endings = F.array(word, front(F.greatest(F.length(word) - 1, F.lit(1))), front(F.greatest(F.length(word) - 2, F.lit(1))))
        asked = F.when(word.rlike(r"\p{IsCyrillic}"), fronts).otherwise(endings) if self._stems else endings
        slot = lambda k: (F.crc32(k.cast("binary")) % self.slots).cast("int")
        found = F.transform(asked, lambda k: F.get(self._filed, slot(k)))
        listed = F.array_join(F.filter(found, lambda f: f != ""), " ")
        return F.when(listed == "", F.array().cast("array<int>")).otherwise(F.array_distinct(F.split(listed, " ")).cast("array<int>"))

    def hits(self, words: Column) -> Column:
        """array<struct<term, start, end>> of every term in an array of plain
        words, by place; ends are exclusive."""

        def stands(word: Column, mark: Column) -> Column:
            bare = F.substr(mark, F.lit(1), F.length(mark) - 1)
            plural = word.isin(bare, F.concat(bare, F.lit("s")), F.concat(bare, F.lit("es")))
            shape = F.rlike(word, F.concat(F.lit("^(?:"), F.substr(mark, F.lit(2)), F.lit(")$")))
            by_mark = F.when(mark.startswith(SHAPE), shape).when(mark.endswith(FRONT), word.startswith(bare)).when(mark.endswith(PLURAL), plural)
            return by_mark.otherwise(word == mark)

        def at(word: Column, start: Column) -> Column:
            def placed(n: Column) -> Column:
                wanted = F.split(F.get(self._words, n), " ")
                return let(wanted, lambda w: F.struct(n.alias("term"), start.alias("start"), (start + F.size(w)).alias("end"), w.alias("w")))

            fits = lambda h: (F.size(words) >= h["end"]) & F.forall(F.zip_with(F.slice(words, start + 1, F.size(h["w"])), h["w"], stands), lambda ok: F.coalesce(ok, F.lit(False)))
            return F.transform(F.filter(F.transform(self._near(word), placed), fits), lambda h: F.struct(h["term"].alias("term"), h["start"].alias("start"), h["end"].alias("end")))

        return F.flatten(F.transform(words, at))
