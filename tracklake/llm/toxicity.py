"""Toxicity by a weighted finite-state pattern grammar over clauses.

Four transducers are composed.  The phrase one joins word sequences of fixed threats to
one symbol.  The frame one lets a verb of violence be a threat only if someone means it: a
first person or somebody (or, where speech is reported, anyone) with will, wish or hope
before the verb, and a person as its object, next to the verb or at most ``NEAR`` words
behind it; or a person who is said to deserve it.  So neither "hang them on the wall" nor
"an attempt to kill him" is one.  The lexical one maps a word to a symbol: insult (by a lexicon of words and
word beginnings learnt from labelled rows), threat, threat with its object, target, target
that can be an object, negation, reported speech, clause end or other.  The context one
reads the symbols of a clause and at its end emits the kinds of what it matched: a plain,
targeted, negated or reported insult, or a threat.  The order within the clause is free:
targets and reports count before and after the word; a negation counts up to ``REACH``
words before it or as the clause's last word; a report before a colon goes on to the next
clause.  A threat needs an object; negated and reported ones count as such.  A text's
score is a logistic function of the counts of matched clauses by kind; isolated words
count only through the clause that they stand in.  The weights of the kinds are fitted on
labelled rows as well.

Labels, languages, sources and ids are never inputs of a score.  Null and empty texts
have no clause and get the score of a text without matches; a text of any length is read
whole.  Rows are scored one by one; an empty table gives an empty one.  Conflicting labels
of one id count by their mean.  Extra columns are passed on, whatever their names; those
of the names of the added ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm.components import written

#: The labelled rows used for fitting, at most so many of each label; chosen by a hash of the id.
FIT_ROWS = 8_000
#: Lengths of word beginnings that may enter the lexicon, besides whole words.
PREFIXES = (4, 5, 6, 7)
#: Documents of label 1 that an entry must occur in, at least (also as a part of all of label 1).
LEAST_DOCS, LEAST_PART = 4, 0.006
#: Least log odds of an entry.
LEAST_LOG_ODDS = 3.5

# Closed word classes of four languages.
OBJECTS = "you u yourself him her dich dir euch ihn ihm te ti toi vous lui os usted ustedes contigo".split()
TARGETS = "them us ihnen sie eux your yours ur du dein deine ihr tu ton ta votre vos tú vosotros eres es he she they these those this".split()
NEGATIONS = "not no never none neither nor without isn't aren't wasn't weren't don't doesn't won't nicht kein keine keinen nie niemals ohne ne pas jamais aucun sans nunca jamás ni sin".split()
REPORTED = "said says say told tells called wrote writes quoted quote claimed claims reported sagte sagt schrieb nannte dit disait écrit dijo dice escribió".split()
THREATS = "kill kills killing murder murders destroy destroys hurt hurts shoot shoots stab stabs burn burns hang strangle strangles töten umbringen ermorden erschießen verprügeln tuer détruire brûler frapper étrangler matar destruir quemar golpear".split()
#: Threats that hold their object: infinitives with a pronoun behind them, and sequences of words.
HARMS = [f"{verb}{who}" for verb in ("matar", "destruir", "quemar", "golpear") for who in ("te", "lo", "la", "los", "las", "os", "le", "les")]
PHRASES = [
    "watch your back", "you are dead", "you're dead", "go die", "drop dead", "hope you die", "will find you", "i'll find you", "beat you up", "you will regret", "you'll regret", "you will pay",
    "bringe dich um", "bring dich um", "bringe euch um", "du bist tot", "ich finde dich", "wirst du bereuen", "wirst es bereuen", "mach dich fertig", "mache dich fertig",
    "tu vas mourir", "vais te trouver", "vas le regretter", "tu es mort", "te faire la peau", "vas a morir", "voy a encontrar", "vas a arrepentir", "estás muerto", "acabar contigo",
]

#: What makes a frame: who means it, that it is meant, both in one word, that it is deserved, and how it ends then; whose and who.
FIRST = "i i'm im we we're someone somebody ich wir jemand je j'ai nous quelqu'un yo nosotros alguien".split()
THIRD = "he she they it er ils elles il elle él ella ellos ellas".split()
INTENT = "will gonna going want wanna shall hope wish would should must werde werden wird soll sollte möchte hoffe vais va allons veux voudrais espère voy vamos quiero espero".split()
IMPLIED = "i'll we'll i'd voy vamos quiero espero ojalá vais allons veux espère werde möchte hoffe".split()
DESERVED = "deserve deserves deserved verdienst verdient verdienen mérites mérite méritez mereces merece merecen".split()
#: Forms that say themselves who deserves it.
ADDRESSED = "mereces merecéis verdienst mérites méritez".split()
SUFFERED = "die shot killed stabbed burned burnt hanged beaten murdered strangled sterben getötet erschossen mourir morir".split()
WHOSE = "your his her their dein deine deinen eure ihre ta ton tes votre vos sa son ses tu tus su sus".split()
WHO = "family mother father mom mum dad wife husband kids children son daughter brother sister parents familie mutter vater kinder frau famille mère père enfants femme familia madre padre hijos esposa".split()
#: Words behind a verb of violence among which its object must stand.
NEAR = 3

OTHER, INSULT, THREAT, HARM, TARGET, OBJECT, NEGATION, REPORT, END, COLON = range(10)
KINDS = ("plain", "targeted", "negated", "reported", "threat")
_CLOSED = {w: s for ws, s in ((TARGETS, TARGET), (OBJECTS, OBJECT), (NEGATIONS, NEGATION), (REPORTED, REPORT), (THREATS, THREAT), (HARMS, HARM)) for w in ws}
_PUNCTUATION = {w: COLON if w == ":" else END for w in ".!?;:\n"}
_WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[.!?;:\n]").findall
#: Words after which a negation no longer holds.
REACH = 3


def _phrases() -> dict[str, list[list[str]]]:
    out: dict[str, list[list[str]]] = {}
    for p in PHRASES:
        out.setdefault(p.split()[0], []).append(p.split())
    return out


_STARTS = _phrases()
_VIOLENT = frozenset([*THREATS, *HARMS, *DESERVED])


def _ended(state: tuple) -> tuple[int, ...]:
    """The kinds that a clause of this state emits."""
    target, objects, report, _, insult, threat, last = state
    out = []
    if insult:
        out.append(2 if insult == 1 or last else 3 if report else 1 if target else 0)
    if threat and objects:
        out.append(2 if threat == 1 or last else 3 if report else 4)
    return tuple(sorted(set(out)))


def _step(state: tuple, symbol: int) -> tuple:
    """A state holds: target, object and report seen, words that a negation still reaches, insult and threat (1: negated, 2: not), negation last."""
    target, objects, report, reach, insult, threat, _ = state
    if symbol in (END, COLON):
        return (0, 0, int(symbol == COLON and report), 0, 0, 0, 0)
    kind = 1 if reach else 2
    if symbol == INSULT:
        insult = max(insult, kind)
    if symbol in (THREAT, HARM):
        threat = max(threat, kind)
    target |= int(symbol in (TARGET, OBJECT))
    objects |= int(symbol in (OBJECT, HARM))
    report |= int(symbol == REPORT)
    return (target, objects, report, REACH if symbol == NEGATION else max(0, reach - 1), insult, threat, int(symbol == NEGATION))


def _context() -> tuple[list[list[int]], list[tuple[int, ...]]]:
    """The table of the context transducer: next state by state and symbol, and the kinds that an end emits by state; 0 is the start."""
    states = [(0,) * 7]
    number, to = {states[0]: 0}, []
    for s in states:
        row = []
        for symbol in range(10):
            t = _step(s, symbol)
            if t not in number:
                number[t] = len(states)
                states.append(t)
            row.append(number[t])
        to.append(row)
    return to, [_ended(s) for s in states]


_TO, _OUT = _context()


@dataclass(frozen=True)
class Grammar:
    """The learnt parts: lexicon entries (word beginnings end with ``*``), and the weights of the kinds."""

    lexicon: tuple[str, ...]
    weights: tuple[float, ...] = (0.0,) * (len(KINDS) + 1)


def _framed(words: list[str], marks: list[int]) -> None:
    """The frame transducer, in place: each THREAT or HARM that is no phrase becomes OTHER, and a threat that is meant a HARM where its object is known.

    The state holds: somebody seen, intent seen, desert seen, a person seen, speech reported,
    an object or a possessive just before, and how many words the last verb still waits.
    """
    who = intent = desert = person = report = before = whose = wait = 0
    for k, (word, mark) in enumerate(zip(words, marks, strict=True)):
        if mark in (END, COLON):
            report = int(mark == COLON and report)
            who = intent = desert = person = before = whose = wait = 0
            continue
        report |= int(mark == REPORT)
        meant = intent and (who or (report and person))
        verb = mark == THREAT
        carried = mark == HARM  # a verb that holds its object
        hit = False
        if verb or carried:
            marks[k] = OTHER
            hit = bool((meant and (carried or before)) or (desert and person))
            wait = 0 if hit or not meant else NEAR + 1
        elif desert and person and word in _SUFFERED:
            hit = True
        elif wait and (mark == OBJECT or (whose and word in _WHO)):
            hit, wait = True, 0
        if hit:
            marks[k] = HARM
        who |= int(word in _FIRST or word in _IMPLIED)
        intent |= int(((word in _INTENT) and (who or report)) or word in _IMPLIED)
        desert |= int(word in _DESERVED)
        person |= int(mark in (OBJECT, TARGET) or word in _THIRD or word in ADDRESSED)
        before, whose, wait = int(mark == OBJECT), int(word in _WHOSE), max(0, wait - 1)


_FIRST, _THIRD, _INTENT, _IMPLIED, _DESERVED, _SUFFERED, _WHOSE, _WHO = map(frozenset, (FIRST, THIRD, INTENT, IMPLIED, DESERVED, SUFFERED, WHOSE, WHO))


class Lexer:
    """The lexical transducer, with the symbols of words met so far in a bounded store."""

    def __init__(self, lexicon: tuple[str, ...]):
        self.whole = {w for w in lexicon if not w.endswith("*")}
        self.starts = {w[:-1] for w in lexicon if w.endswith("*")}
        self.lengths = sorted({len(w) for w in self.starts})
        self.store: dict[str, int] = {}

    def symbol(self, word: str) -> int:
        s = self.store.get(word)
        if s is None:
            if len(self.store) > 100_000:
                self.store.clear()
            s = _CLOSED.get(word, _PUNCTUATION.get(word, OTHER))
            if s == OTHER and (word in self.whole or any(word[:k] in self.starts for k in self.lengths if k <= len(word))):
                s = INSULT
            self.store[word] = s
        return s

    def clauses(self, text: str) -> list[int]:
        """Counts of matched clauses by kind."""
        counts = [0] * len(KINDS)
        words = _WORDS(text.lower())
        symbol = self.store.get
        marks = [s if (s := symbol(w)) is not None else self.symbol(w) for w in words]
        held = set(words)
        if not _VIOLENT.isdisjoint(held):
            _framed(words, marks)
        for start in _STARTS.keys() & held:
            for k in [k for k, w in enumerate(words) if w == start]:
                if any(words[k : k + len(p)] == p for p in _STARTS[start]):
                    marks[k] = HARM
        if not {INSULT, THREAT, HARM}.intersection(marks):
            return counts
        state = 0
        for s in [*marks, END]:
            if s >= END:
                for kind in _OUT[state]:
                    counts[kind] += 1
            state = _TO[state][s]
        return counts


def _features(counts: np.ndarray) -> np.ndarray:
    """log(1 + count) of each kind, and a constant."""
    return np.column_stack([np.log1p(counts), np.ones(len(counts))])


def clause_counts(df: DataFrame, lexicon: tuple[str, ...], text: str = "text") -> DataFrame:
    """Adds the number of matched clauses of each kind."""

    @F.pandas_udf(", ".join(f"{k} int" for k in KINDS))
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lexer = Lexer(lexicon)
        for s in batches:
            yield pd.DataFrame([lexer.clauses(t or "") for t in s], columns=list(KINDS), dtype="int32")

    clauses = count(F.col(text))
    return df.withColumn("clauses", clauses)


def fit_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int) -> DataFrame:
    """Labelled texts, at most ``rows`` of each label, chosen by a hash of the id; the labels are bounded and so broadcast."""
    y = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    some = [y.where(F.col("y") == v).orderBy(F.xxhash64("__k"), "__k").limit(rows) for v in (0, 1)]
    chosen = some[0].unionByName(some[1])
    texts = docs.select(F.col(key).alias("__d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return texts.join(F.broadcast(chosen), F.col("__d") == F.col("__k")).select("__k", "t", "y")


def learn_lexicon(rows: DataFrame) -> tuple[str, ...]:
    """Words and word beginnings that mark label 1, from documents (t, y); at most 1 / LEAST_PART entries a text's word."""
    words = F.array_distinct(F.filter(F.split(F.lower("t"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))

    def beginnings(k: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) >= k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))

    entries = F.concat(words, *map(beginnings, PREFIXES))
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return ()
    counts = rows.select("y", F.explode(F.array_distinct(entries)).alias("e")).groupBy("e").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    odds = F.log(((F.col("p") + 0.5) / (n1 + 1.0)) / ((F.col("n") + 0.5) / (n0 + 1.0)))
    candidates = counts.where((F.col("p") >= max(LEAST_DOCS, LEAST_PART * n1)) & (odds >= LEAST_LOG_ODDS) & ~F.col("e").isin(*_CLOSED)).select("e")
    # The candidates of each fitting row that has any, equal rows counted together: bounded by the fitting rows.
    some = rows.select("__k", "y", F.explode(F.array_distinct(entries)).alias("e")).join(F.broadcast(candidates), "e")
    held = some.groupBy("__k", "y").agg(F.array_sort(F.collect_set("e")).alias("es")).groupBy("y", "es").agg(F.count(F.lit(1)).alias("n")).collect()
    return _cover([(r["es"], r["n"] if r["y"] else 0, 0 if r["y"] else r["n"]) for r in held], max(2, LEAST_PART * n1))


def _cover(rows: list[tuple[list[str], int, int]], least: float) -> tuple[str, ...]:
    """Entries one by one, each that with the most rows of label 1 that no earlier entry has, and at least ``least``.

    Words that only keep company with insults have few such rows and do not enter.  Of
    entries with the same rows the longest enters, the whole word first.
    """
    of: dict[str, set[int]] = {}
    for k, (es, _, _) in enumerate(rows):
        for e in es:
            of.setdefault(e, set()).add(k)
    left, out = set(range(len(rows))), []
    while of:
        gain = {e: (sum(rows[k][1] for k in ks) - 10 * sum(rows[k][2] for k in ks), not e.endswith("*"), len(e), e) for e, ks in of.items()}
        e = max(gain, key=gain.__getitem__)
        if gain[e][0] < least:
            break
        out.append(e)
        left -= of[e]
        # A row of label 0 goes on counting against other entries.
        left |= {k for k in of[e] if rows[k][2]}
        of = {x: ks for x, ks in ((x, ks & left) for x, ks in of.items()) if sum(rows[k][1] for k in ks) >= least}
    return tuple(sorted(out))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> Grammar:
    """The grammar of labelled rows: ``labels`` must hold the training rows only.

    What comes to the driver is bounded: five small counts and a label for each of at
    most 2 x ``rows`` fitting rows, grouped by equal counts, and the lexicon's candidates.
    """
    sample = written(fit_rows(docs, labels, key, text, label, rows))
    lexicon = learn_lexicon(sample)
    grouped = clause_counts(sample, lexicon, "t").groupBy("clauses", "y").agg(F.count(F.lit(1)).alias("n")).collect()
    if not grouped or len({r["y"] for r in grouped}) < 2:
        return Grammar(lexicon)
    x = _features(np.array([[r["clauses"][k] for k in KINDS] for r in grouped], float))
    y, n = np.array([r["y"] for r in grouped], float), np.array([r["n"] for r in grouped], float)
    # Labels with errors: both classes count alike, the ridge keeps rare kinds near a small positive prior.
    n = n / np.where(y == 1, n[y == 1].sum(), n[y == 0].sum()) * n.sum() / 2
    prior = np.array([3.0, 3.5, 1.0, 1.0, 4.5, -2.0])
    ridge = np.array([1.0] * len(KINDS) + [1e-3])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (n * (y - p)) - ridge * (w - prior))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    w[:-1] = np.maximum(w[:-1], 0)  # a matched clause never speaks for a clean text
    return Grammar(lexicon, tuple(float(v) for v in w))


def score(grammar: Grammar) -> Column:
    """The score from the column ``clauses``."""
    z = F.lit(grammar.weights[-1])
    for k, w in zip(KINDS, grammar.weights, strict=False):
        z = z + F.lit(w) * F.log1p(F.col(f"clauses.{k}").cast("double"))
    return 1 / (1 + F.exp(-z))


def toxicity(docs: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """Adds clauses (counts by kind) and score."""
    return clause_counts(docs, grammar.lexicon, text).withColumn("score", score(grammar))


def held_out(key: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
