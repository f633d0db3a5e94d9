"""Scores for abusive, hateful and sexual content.

Every line of a text is freed of disguise (invisible characters, look-alike letters, spelled-out words, entities) and cut
into tokens. A token is matched with the lexicon by walking the trie of its terms under a Levenshtein automaton: digits and
signs stand for the letters they imitate or hide, stretched letters count once, and longer words and short insults may have
a spelling mistake, the first letter included, if they are not themselves ordinary words. What decides is the window round a term: turns of phrase (aimed at
someone, against a people, threats, lewd acts) give weights, while quotation marks round it and words that speak about
words, rules or reports before it take most of a weight away. Insults in no turn have a weight of their own by what aims
them: "you" or a copula a few words before, the page's makers near by, a line of little else.

Lines are scored once per worker and remembered, for revisions and copies repeat most of theirs.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fotoloom.llm.lexicon import AIMING, AMBIGUOUS, ANYWHERE, COPULAS, CROWDS, DESCRIBING, ENDING, EXACT, MAKERS, NO_MISTAKE, REPORTING, SETS, SHORT, STRONG, TERMS, TURNS

THRESHOLD = 0.5
QUOTED = 0.3  # of a weight is left inside quotation marks or after words that report
REMEMBERED = 12_000_000
LONG_LINE = 2_000
BEFORE = 6  # tokens that are searched for words that report
AFTER = 10  # tokens from its first on that are searched for who said it
QUOTATION = 60  # tokens of a quotation at most
EDGE, EDGE_CHARS = 8, 120  # tokens on each side of a line break that are looked at together, within so many characters
BETWEEN = 3  # free words between a term and what aims it
ALONE, AIMED = 0.6, 0.8  # weights of an insult outside turns
_NEAR = {"bastard", "bitch", "jackass", "dick", "fool", "clown", "ass"}  # of class j, insults with one or two free words after "you"

_INVISIBLE = {c: None for c in (0xAD, 0x34F, 0x61C, 0x180E, 0xFEFF, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10))}
_INVISIBLE |= {c: None for c in (*range(0, 9), 11, 12, *range(14, 32), 127)}
_LIKE = str.maketrans("аеорсхуікмтвнѕјԁɡοαερνι", "aeopcxyikmtbhsjdgoaepvi")
_LETTERS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "+": "t"}
_HIDING = set("@$%#*!")
_SPELLED = re.compile(r"(?<![^\W_])[^\W_](?:([ ._\-*])[^\W_])(?:\1[^\W_]){1,}(?![^\W_])")
_TOKENS = re.compile(r'["“”„«»「」]|[@$]?[^\W_](?:[\w@$%#*+]*[^\W_+$@*%#]|[\w@$%#*+]*[+$@])?')
_IDIOMS = {("so", "called"), ("my", "words"), ("my", "word")}  # report nothing
_TELLERS, _TOLD = {"he", "she", "they"}, {"said", "says", "shouted", "wrote", "yelled", "replied", "claimed", "added"}
_QUOTES = set('"“”„«»「」')
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_DOUBLED = re.compile(r"(.)\1+")
_CONTRACTED = re.compile(r"(?<=n)['’](?=t\b)|(?<=\w)['’](?=(?:ll|re|s|m|d|ve)\b)")
_MIXED = re.compile(r"[a-z].*[Ѐ-ӿͰ-Ͽ]|[Ѐ-ӿͰ-Ͽ].*[a-z]")


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


class Trie:
    """Terms by letters; `walk` runs a Levenshtein automaton along it."""

    def __init__(self, terms: dict[str, str]):
        self.root: dict = {}
        for term, value in terms.items():
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = (term, value)

    def walk(self, word: list[str | None], budget: int) -> tuple[int, str, str] | None:
        """The best (edits, term, value) within the budget. word: the letters each place may stand for, None for any."""
        n = len(word)
        best: tuple[int, str, str] | None = None

        def fits(place: str | None, c: str) -> bool:
            return place is None or c in place

        stack = []
        start = list(range(n + 1))
        for c, child in self.root.items():
            if c:
                stack.append((child, c, start, None, ""))
        while stack:
            node, c, above, above2, before = stack.pop()
            row = [above[0] + 1]
            for k in range(1, n + 1):
                cost = above[k - 1] + (not fits(word[k - 1], c))
                cost = min(cost, above[k] + 1, row[k - 1] + 1)
                if above2 is not None and k > 1 and word[k - 2] and word[k - 1] and c in word[k - 2] and before in word[k - 1]:
                    cost = min(cost, above2[k - 2] + 1)
                row.append(cost)
            if "" in node and row[n] <= budget and (best is None or (row[n], node[""][0]) < best[:2]):
                best = (row[n], *node[""])
            if min(row) <= budget:
                for d, child in node.items():
                    if d:
                        stack.append((child, d, row, above, c))
        return best


def _compile(turn: str) -> re.Pattern:
    for name, words in SETS.items():
        turn = turn.replace(f"<{name}>", f"(?:{words})")
    for short, long in (("<i>", r"i:\S+"), ("<ij>", r"[ij]:\S+"), ("<a>", r"(?:a:\S+ )+"), ("<a?>", r"(?:a:\S+ )*"), ("_ ", r"\S+ ")):
        turn = turn.replace(short, long)
    return re.compile(rf"(?<= )(?:{turn})(?![^\s])" if not turn.endswith((":", " ")) else rf"(?<= )(?:{turn})")


#: Common words: a line is looked into for one of these only where a way through a turn has no other word.
_COMMON = set(
    """
    a all alle am an and any anyone anywhere are as at back be been being big biggest black border both building but by can country das den
    der des die doch does don dont du each ein eine einer eres es est et everyone for from get going good he her him his house i ich if in into is it
    its jump keep kind la las last le les let ll los m me mit most must my near need needs never new next no not nur of off on one only or ought out over own
    page past people person place que re read reads river road s sa see set she should si sie sind so some someone son sont spring still street such t ta tat te than that the
    their them they this time to too tower town truly u un una und une unos up us vote votre vous want wants war was we were what where who whoever
    will with women would y you your yours ya ur youre youll ist bist seid hay no pas ne qu on ou je tu il elle sais sais t vais vont va faire etes vraiment
    summer morning tomorrow children legs face live lives fire water every everywhere wherever share church village train bridge roof tree head hard wet her thick
    ok hot girls came sex fun night neck arm arms sea zoo camps chains fly flies rules state states stay out good habria se voy vamos
    es esta el del de al a por para con donde todos son les il faut tous ces
    just nothing really such totally completely truly fat deep right dirty lazy touch grab eat kiss author authors editor editors admin admins cares loves likes
    ты вы он она все их всех на и надо найду
    ty jij wat een e sei da
    """.split()
)


#: Names of groups are common too: what is said of them tells.
_GROUP = re.compile(SETS["group"])


def _common(word: str) -> bool:
    return word in _COMMON or _GROUP.fullmatch(word) is not None


def _quotations(tokens: list[str]) -> list[tuple[int, int]]:
    """Places of the quotation marks of each quotation. A mark without another within `QUOTATION` tokens, or after a number
    where none is open (an inch sign), begins none."""
    out, begun = [], -1
    for n, t in enumerate(tokens):
        if t in _QUOTES:
            if begun >= 0 and n - begun <= QUOTATION:
                out.append((begun, n))
                begun = -1
            elif not (t == '"' and n and tokens[n - 1].isdecimal()):
                begun = n
    return out


def _keys(pattern: str) -> set[str]:
    """Words, or classes such as "i:", of which every match of a pattern over tokens holds one; "" if a match may hold none.

    Runs through all ways of the pattern at once; a way is its best key so far and the token it is within, \\0 in a token
    being anything.
    """

    def closed(way: tuple[str, str]) -> tuple[str, str]:
        best, token = way
        token = token[:2] if token[1:2] == ":" and token[0] != "\0" else "" if "\0" in token else token
        return max(best, token, key=lambda t: (bool(t), not _common(t), len(t), t)), ""

    def char(ways: set[tuple[str, str]], c: str) -> set[tuple[str, str]]:
        return {closed(w) for w in ways} if c == " " else {(best, token + c) for best, token in ways}

    def run(ways: set[tuple[str, str]], nodes) -> set[tuple[str, str]]:
        for op, value in nodes:
            name = str(op)
            if name == "LITERAL":
                ways = char(ways, chr(value))
            elif name == "IN":
                parts = [chr(v) if str(o) == "LITERAL" else " " if str(v) == "CATEGORY_SPACE" else "\0" for o, v in value]
                ways = set().union(*(char(ways, c) for c in parts))
            elif name == "BRANCH":
                ways = set().union(*(run(ways, b) for b in value[1]))
            elif name == "SUBPATTERN":
                ways = run(ways, value[3])
            elif name == "MAX_REPEAT":
                least, most, body = value
                once = run(ways, body)
                more = run(char(once, "\0"), body) if most > 1 else set()
                ways = (ways if not least else set()) | once | more
            elif name not in ("AT", "ASSERT", "ASSERT_NOT"):
                raise ValueError(f"a turn with {name}: {pattern}")
        return ways

    return {closed(w)[0] for w in run({("", "")}, _parser.parse(pattern))}


class Scorer:
    def __init__(self, vocabulary: str | None = None):
        from fotoloom.llm.encoding import default_vocabulary, encoder

        self._ordinary = encoder(vocabulary or default_vocabulary()).ranks
        self._class: dict[str, str] = {}
        for c, words in TERMS.items():
            for w in words.split():
                self._class.setdefault(fold(w), c)
        named = {w: (w if c == "w" else f"{c}:{w}") for w, c in self._class.items()}
        self._named = named
        self._trie = Trie(named)
        self._long = Trie({w: v for w, v in named.items() if (len(w) >= 6 or w in SHORT) and w not in EXACT})
        self._short = {named[w] for w in SHORT}
        self._longer = Trie({w: v for w, v in named.items() if len(w) >= 10})
        self._single = Trie({_DOUBLED.sub(r"\1", w): v for w, v in named.items()})
        self._turns = [(_compile(fold(t)), w) for t, w in TURNS]
        self._said = REPORTING.union(NO_MISTAKE, *(re.findall(r"[^\W\d_]+", fold(t)) for t, _ in TURNS))
        self._by_word: dict[str, list[int]] = defaultdict(list)
        self.loose: list[int] = []  # turns that are tried on every line
        for k, (turn, _) in enumerate(self._turns):
            for w in _keys(turn.pattern):
                if w:
                    self._by_word[w].append(k)
                else:
                    self.loose.append(k)
        self._anywhere = [(p, w) for p, w in ANYWHERE]
        self._anywhere_any = re.compile("|".join(re.escape(p) for p, _ in ANYWHERE))
        self._known: dict[str, tuple[str, str]] = {}
        self._lines: dict[str, tuple[float, str | None, str | None]] = {}
        self._pairs: dict[tuple[str, str], float] = {}
        self._size = 0

    def _match(self, token: str) -> tuple[str, str]:
        """The token as it stands in turns, and the key under which turns are looked up ('' for none)."""
        word = token.translate(_LIKE) if not token.isascii() and _MIXED.search(token) else token
        if not word.isascii():
            word = fold(word)
        found = self._named.get(word)
        if found is None and len(word) >= 3:
            letters = sum(c.isalpha() for c in word)
            if letters < len(word):
                signs = sum(c in _HIDING or c == "+" for c in word)
                if len(word) >= 4 and (letters >= 2 or (letters and signs)) and len(word) <= 24:
                    places = [None if c in _HIDING else _LETTERS.get(c, c) for c in word]
                    hit = self._trie.walk(places, 0)
                    if hit is None and letters >= 3 and len(word) >= 5:
                        hit = self._long.walk(places, 1)
                    found = hit[2] if hit else None
            else:
                squeezed = _STRETCHED.sub(r"\1", word)
                if squeezed != word and len(squeezed) >= 3:
                    hit = self._named.get(squeezed) or self._single.walk(list(_DOUBLED.sub(r"\1", word)), 0)
                    found = hit if isinstance(hit, str) else hit[2] if hit else None
                if found is None:
                    found = self._misspelled(squeezed)
        out = found or word
        key = out[:2] if out[1:2] == ":" else (out if out in self._by_word else "")
        return out, key

    def _misspelled(self, word: str) -> str | None:
        """The term a word of letters alone is a spelling mistake of. Ordinary words and words of turns are themselves."""
        if not 4 <= len(word) <= 24 or word in self._said or any((" " + w).encode() in self._ordinary for w in (word, word.capitalize())):
            return None
        hit = self._long.walk(list(word), 1) or (self._longer.walk(list(word), 2) if len(word) >= 10 else None)
        return hit[2] if hit else None

    def _joined(self, m: re.Match) -> str:
        """Spelled-out letters as a word; a first letter that is a word of its own ("a m o r o n") may stand apart."""
        word = re.sub(r"[ ._\-*]", "", m.group(0))
        if m.group(1) == " " and len(word) > 3 and not self._match(word)[1] and self._match(word[1:])[1]:
            return f"{word[0]} {word[1:]}"
        return word

    def _is_name(self, token: str, line: str) -> bool:
        """Whether a word that looks like a misspelled short term stands in the line as a name does, as in "was Lunt"."""
        m = re.search(rf"(\w*[^\W\d_A-Z]),? {re.escape(token.capitalize())}(?!\w)", line)
        return m is not None and m.group(1).lower() not in ("you", "u", "a", "an", "such", "these") and not self._match(m.group(1).lower())[0].startswith("a:")

    def tokens(self, line: str) -> tuple[list[str], set[str]]:
        if not line.isascii():
            line = unicodedata.normalize("NFKC", line.translate(_INVISIBLE))
        if "&" in line:
            line = html.unescape(line).replace(" ", " ")
        cased = line
        line = _SPELLED.sub(self._joined, line.lower())
        known, out, keys = self._known, [], set()
        if "'" in line or "’" in line:
            line = _CONTRACTED.sub("", line).replace("'", " ").replace("’", " ")
        for token in _TOKENS.findall(line):
            pair = known.get(token)
            if pair is None:
                pair = self._match(token)
                if len(known) > 400_000:
                    known.clear()
                known[token] = pair
            if pair[0] in self._short and token.isalpha() and token not in self._named and self._is_name(token, cased):
                pair = (token, "")
            out.append(pair[0])
            if pair[1]:
                keys.add(pair[1])
        return out, keys

    def hits(self, line: str, indexed: bool = True) -> list[tuple[str, float]]:
        """The turns found in a line with their weights in their context. indexed: try only the turns a key of which it holds."""
        found: list[tuple[str, float]] = []
        if not line.isascii():
            bare = unicodedata.normalize("NFKC", line.translate(_INVISIBLE))
            if self._anywhere_any.search(bare):
                for p, w in self._anywhere:
                    # The worst place of a term counts, once.
                    at, worst = bare.find(p), 0.0
                    while at >= 0:
                        inside = any(bare.rfind(a, 0, at) > bare.rfind(b, 0, at) and bare.find(b, at) >= 0 for a, b in ("「」", "『』"))
                        worst = max(worst, w * (QUOTED if inside else 1))
                        at = bare.find(p, at + 1)
                    if worst:
                        found.append((p, worst))
        tokens, keys = self.tokens(line)
        found += self._turned(tokens, keys, line, indexed)
        return found

    def _turned(self, tokens: list[str], keys: set[str], line: str, indexed: bool = True, across: int = 0) -> list[tuple[str, float]]:
        """The turns and insults of a line's tokens; across: only the turns that hold the tokens on both sides of that place."""
        found: list[tuple[str, float]] = []
        taken: set[int] = set()  # tokens within turns
        if indexed:
            turns = sorted({*self.loose, *(k for key in keys for k in self._by_word.get(key, ()))})
        else:
            turns = list(range(len(self._turns)))
        if turns:
            flat = " " + " ".join(tokens) + " "
            for k in turns:
                pattern, weight = self._turns[k]
                for m in pattern.finditer(flat):
                    at = len(flat[: m.start()].split())
                    if across and not at < across < at + len(m.group(0).split()):
                        continue
                    told = self._told(tokens, at)
                    taken.update(range(at, at + len(m.group(0).split())))
                    found.append((m.group(0).strip(), weight * (QUOTED if told else 1)))
        if not across and ("i:" in keys or "j:" in keys):
            for at, token in enumerate(tokens):
                if token[:2] in ("i:", "j:") and at not in taken and (weight := self._alone(tokens, at, line)):
                    found.append((token, weight))
        return found

    def _told(self, tokens: list[str], at: int) -> bool:
        """Whether what begins at a token is quoted or reported, before it or after it."""
        after = tokens[at : at + AFTER]
        if any(a in _TELLERS and b in _TOLD for a, b in zip(after, after[1:])):
            return True
        return any(a < at < b for a, b in _quotations(tokens)) or any(
            tokens[n] in REPORTING and not (n and (tokens[n - 1], tokens[n]) in _IDIOMS) for n in range(max(0, at - BEFORE), at)
        )

    def _alone(self, tokens: list[str], at: int, line: str) -> float:
        """The weight of an insult that stands in no turn: what aims it raises it, words that tell of it or describe take it away."""
        term = tokens[at][2:]
        if self._told(tokens, at) or any(t in DESCRIBING or t in REPORTING for t in (*tokens[max(0, at - BEFORE) : at], *tokens[at + 1 : at + 1 + BEFORE])):
            return 0.0
        before = tokens[max(0, at - BETWEEN - 1) : at][::-1]
        if tokens[at][0] == "j":
            return AIMED if term in _NEAR and "you" in before[1:3] and not {"a", "an", "the", "your", "his", "her"} & set(before[: before.index("you")]) and not ENDING & set(before[: before.index("you")]) else 0.0
        vague, after = term in AMBIGUOUS, tokens[at + 1 : at + 1 + BETWEEN]
        for k, t in enumerate(before):
            if t == "of" and CROWDS & set(before[k + 1 : k + 2]) or t in AIMING or (t in COPULAS and not vague and before[0] != "the"):
                return AIMED
            if t in ENDING:
                break
        if after[:1] and after[0] in ("you", "u"):
            return AIMED
        if term in STRONG:
            return ALONE
        if vague or before[:1] == ["the"]:
            return 0.0
        if MAKERS & {*before, *after}:
            return AIMED
        # Hardly anything else in the line, which is no heading, link or entry.
        return AIMED if len(tokens) <= 3 and not line.lstrip().startswith(("=", "[", "*", "#", "|", "{")) or len(tokens) <= 3 and "!" in line else 0.0

    def score(self, text: str | None) -> float:
        """From 0 to 1: one minus the product of what each turn leaves of innocence."""
        if not text:
            return 0.0
        left, before = 1.0, None
        for line in text.split("\n"):
            if not line.strip():
                before = None
                continue
            known = self._lines.get(line)
            if known is None:
                one = 1.0
                for _, w in self.hits(line):
                    one *= 1 - w
                known = (one, self._edge(line[:EDGE_CHARS], True), self._edge(line[-EDGE_CHARS:], False))
                if len(line) <= LONG_LINE:
                    if self._size > REMEMBERED:
                        self._lines.clear()
                        self._size = 0
                    self._lines[line] = known
                    self._size += len(line) + 40
            left *= known[0]
            if before and known[1]:
                left *= self._across(before, known[1])
            before = known[2]
        return 1.0 - left

    def _edge(self, part: str, first: bool) -> str | None:
        """The tokens at an end of a line, or None where it ends in markup or a sentence does, which nothing runs over."""
        bare = part.strip()
        if bare[:1] in tuple("=*#|{!:;[<-") if first else bare[-1:] in tuple("=|}.!?:;]>-"):
            return None
        tokens, _ = self.tokens(bare)
        return " ".join(tokens[:EDGE] if first else tokens[-EDGE:]) or None

    def _across(self, before: str, after: str) -> float:
        """What the turns over a line break leave of innocence."""
        pair = (before, after)
        left = self._pairs.get(pair)
        if left is None:
            left, ahead = 1.0, before.split()
            tokens = ahead + after.split()
            keys = {t[:2] if t[1:2] == ":" else t for t in tokens if t[1:2] == ":" or t in self._by_word}
            for _, w in self._turned(tokens, keys, "", across=len(ahead)):
                left *= 1 - w
            if len(self._pairs) > 50_000:
                self._pairs.clear()
            self._pairs[pair] = left
        return left


@lru_cache(maxsize=2)
def scorer(vocabulary: str | None = None) -> Scorer:
    """One to a worker process."""
    return Scorer(vocabulary)


def score_documents(documents: DataFrame, doc_id: str, text: str, *keep: str, vocabulary: str | None = None) -> DataFrame:
    """`doc_id`, the columns to keep, `score` (0 to 1) and `abusive` (score at least `THRESHOLD`) of each whole text.

    Defined results: null, empty and blank texts score 0; rows with a null id are kept; repeated rows are each scored; an
    empty table stays empty; other columns are ignored. Nothing is shuffled.
    """
    names = [doc_id, *keep]
    slim = documents.select(*(documents[c] for c in names), documents[text].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(vocabulary).score
        for batch in batches:
            scores = np.array([score(t) for t in batch.column(len(names)).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores), pa.array(scores >= THRESHOLD)], names=[*names, "score", "abusive"])

    schema = T.StructType([*(slim.schema[c] for c in names), T.StructField("score", T.DoubleType()), T.StructField("abusive", T.BooleanType())])
    return slim.mapInArrow(run, schema)


def source_rates(scored: DataFrame, source: str) -> DataFrame:
    """`source` (trimmed, lower case; null stays null), `documents`, `abusive` and `rate` per source."""
    return (
        scored.groupBy(F.lower(F.btrim(source)).alias("source"))
        .agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("abusive"), 1)).alias("abusive"))
        .withColumn("rate", F.col("abusive") / F.col("documents"))
    )
