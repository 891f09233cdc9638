"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer maps the words of a clause to symbols: strong and weak insults, threats, targets, negations,
reporting words, anything else. Transducers rewrite the symbols: reported speech and negation turn what they govern into
mitigated matches; an insult is targeted, and a threat counts, only where a target stands near. The three that read from
left to right are composed into one machine; one more reads its output from right to left, for targets that follow.
The arcs' weights add up to the weight of a clause, the clauses' to that of the document. An insult that no pattern
attaches to a target, or that is mitigated, weighs ``BARE`` of a targeted one or less.

Targets, threats, negations and reporting words are closed lists in four languages; which of them holds is told by the
text's own words. What is learned, on the driver, from a bounded sample of labelled rows (``TRAIN_ROWS``,
``TRAIN_CHARS``): the insults, that is words and word beginnings whose share in toxic texts is beyond chance, and the
weights of the arcs, fitted around the prior weights below. Labels of the held-out fold are never read.

Defined results: null, blank and very short texts have no match and get the lowest score; long texts are read whole;
repeated rows get equal scores; without any labelled row the seed lexicon and prior weights score alone; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import labelled_sample, slices

TRAIN_ROWS, TRAIN_CHARS = 4_000, 20_000
HELD_OUT = "crc32(cast(doc_id as string)) % 3 = 1"
CUT = 0.7

#: Seeds of the insults; learned ones come to them.
INSULTS = (
    "idiot idiots moron morons stupid dumb imbecile cretin fool loser losers scum trash garbage filth vermin pathetic worthless disgusting clown bastard pig coward scumbag retard jerk freak ugly "
    "dummkopf trottel abschaum idioten imbécile crétin abruti ordure imbécil estúpido basura escoria"
).split()
#: The other classes, by language: closed lists.
ROLES = {
    "en": {
        "target": "you your yours u ur you're youre he him his she her it they him them their we us i me the a an this that these those people everyone everybody",
        "threat": "kill hurt beat destroy shoot stab punch strangle burn smash attack murder crush slap die hang",
        "negation": "not no never isn't aren't wasn't don't doesn't didn't nobody neither nor without cannot can't won't",
        "report": "said says saying told reported reports claimed claims called quoted quote quoting wrote writes according alleged allegedly accused heard",
    },
    "de": {
        "target": "du dein deine dich dir ihr euch euer sie er ihn ihm es wir uns ich mich der die das den dem des ein eine einen diese dieser dieses leute alle",
        "threat": "töten töte schlagen schlage erschießen verprügeln vernichten zerstören verbrennen umbringen erwürgen",
        "negation": "nicht kein keine keinen nie niemals niemand ohne weder noch",
        "report": "sagte sagt gesagt behauptete behauptet berichtete berichtet laut zitierte schrieb angeblich nannte",
    },
    "fr": {
        "target": "tu toi ton ta tes te vous votre vos il elle lui ils elles eux on nous je moi le la les un une des du ce cet cette ces gens tous",
        "threat": "tuer tue frapper frappe détruire brûler étrangler écraser abattre poignarder",
        "negation": "ne pas jamais non personne ni sans aucun aucune",
        "report": "dit disait déclaré affirme affirmé rapporte rapporté selon cité écrit prétend prétendu appelé",
    },
    "es": {
        "target": "tú tu tus ti te usted ustedes vosotros él ella lo le les ellos ellas nos nosotros yo me el la los las un una unos unas este esta estos estas ese esa gente todos",
        "threat": "matar mataré golpear pegar destruir quemar estrangular aplastar disparar apuñalar",
        "negation": "no nunca jamás nadie ni sin ningún ninguna tampoco",
        "report": "dijo dice dicen informó afirma afirmó según citó escribió supuestamente llamó",
    },
}

INSULT, WEAK, THREAT, TARGET, NEGATION, REPORT, END, OTHER = b"IWTYNRE."
_ROLE = {"target": TARGET, "threat": THREAT, "negation": NEGATION, "report": REPORT}
#: What the machines make of insults and threats: targeted strong and weak ones, threats that meet a target, mitigated.
TARGETED, TARGETED_WEAK, MEANT, MITIGATED = b"JVKm"
_PARTS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;\n]")
_HOT = re.compile(rb"[IWT]")
#: Classes of matches: the arcs that weigh in them, and their weights. Bare and mitigated ones weigh BARE of targeted ones.
BARE = 0.25
ARCS = ({TARGETED: 1.0, INSULT: BARE, MITIGATED: BARE / 2}, {TARGETED_WEAK: 1.0, WEAK: BARE}, {MEANT: 1.0})
#: Prior weights of the classes, the bias last.
PRIOR = np.asarray([4.0, 2.0, 2.0, -2.5])
RIDGE = 0.05
#: Log-likelihood ratio beyond which a word or word beginning is toxic beyond chance, and beginnings' lengths.
LEAST_RATIO, STEMS = 20.0, range(4, 9)
_KNOWN_WORDS = 300_000


@dataclass(frozen=True)
class Transducer:
    """A deterministic letter transducer over byte symbols: ``step[state][symbol]`` is (next state, output)."""

    step: tuple[dict[int, tuple[int, int]], ...]

    def run(self, symbols: bytes) -> bytearray:
        out, state = bytearray(), 0
        for x in symbols:
            state, y = self.step[state].get(x) or self.step[state][OTHER]
            out.append(y if y != OTHER else x)
        return out

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one writes. States are pairs, of those that can be reached."""
        pairs, at, steps = [(0, 0)], {(0, 0): 0}, []
        alphabet = {x for s in (*self.step, *other.step) for x, (_, y) in s.items()} | {y for s in (*self.step, *other.step) for _, y in s.values()}
        for p, q in pairs:
            row = {}
            for x in alphabet:
                a, y = self.step[p].get(x) or self.step[p][OTHER]
                y = x if y == OTHER else y
                b, z = other.step[q].get(y) or other.step[q][OTHER]
                z = y if z == OTHER else z
                if (a, b) not in at:
                    at[a, b] = len(pairs)
                    pairs.append((a, b))
                row[x] = (at[a, b], z)
            steps.append(row)
        return Transducer(tuple(steps))


def _scope(opener: int, becomes: dict[int, int], reach: int | None) -> Transducer:
    """After ``opener``, for ``reach`` symbols (None: to the end), symbols become what ``becomes`` says. State: symbols
    left. A step's output OTHER leaves the symbol as it is."""
    last = 1 if reach is None else reach
    rows = [{opener: (last, OTHER), OTHER: (0, OTHER)}]
    for left in range(1, last + 1):
        on = left if reach is None else left - 1
        rows.append({opener: (last, OTHER), OTHER: (on, OTHER), **{x: (on, y) for x, y in becomes.items()}})
    return Transducer(tuple(rows))


_SOFTER = {INSULT: MITIGATED, WEAK: MITIGATED, THREAT: MITIGATED}
_AIMED = {INSULT: TARGETED, WEAK: TARGETED_WEAK, THREAT: MEANT}
#: From left to right: reported speech, to the end of the clause; negation, four words on; a target, eight words on.
FORWARD = _scope(REPORT, _SOFTER, None).then(_scope(NEGATION, _SOFTER, 4)).then(_scope(TARGET, _AIMED, 8))
#: From right to left: a target up to six words behind.
BACKWARD = _scope(TARGET, _AIMED, 6)


class _Lexicon(dict):
    """Word -> code, one byte; remembers words while there is room. A code says what the word is in each language."""

    def __init__(self, strong: set[str], stems: set[str], weak: set[str]):
        roles: dict[str, list[int]] = {w: [WEAK] * len(ROLES) for w in INSULTS}
        roles.update({w: [INSULT] * len(ROLES) for w in strong})
        roles.update({w: [END] * len(ROLES) for w in ".!?;\n"})
        for i, classes in enumerate(ROLES.values()):
            for role, words in classes.items():
                for w in words.split():
                    roles.setdefault(w, [OTHER] * len(ROLES))[i] = _ROLE[role]
        kinds = sorted({tuple(r) for r in roles.values()} | {(x,) * len(ROLES) for x in (INSULT, WEAK, END, OTHER)})
        code = {k: i for i, k in enumerate(kinds)}
        super().__init__({w: code[tuple(r)] for w, r in roles.items()})
        self.insult, self.weak_code, self.other = (code[(x,) * len(ROLES)] for x in (INSULT, WEAK, OTHER))
        self.hot = re.compile(b"[" + b"".join(re.escape(bytes([c])) for k, c in code.items() if set(k) & {INSULT, WEAK, THREAT}) + b"]")
        #: By language: symbol of each code, and which codes speak for the language.
        self.symbols = [bytes([k[i] for k in kinds]).ljust(256, b".") for i in range(len(ROLES))]
        self.speaks = np.asarray([[k[i] in (TARGET, NEGATION, REPORT) for k in kinds] for i in range(len(ROLES))], float)
        self.stems, self.weak = stems, weak

    def __missing__(self, word: str) -> int:
        starts = {word[:n] for n in STEMS if len(word) > n}
        code = self.insult if starts & self.stems else self.weak_code if starts & self.weak else self.other
        if len(self) < _KNOWN_WORDS:
            self[word] = code
        return code

    def read(self, text: str) -> bytes:
        """The symbols of a text, in the language whose words it has most of; none if there is nothing to match."""
        codes = bytes(map(self.__getitem__, _PARTS.findall(text.lower())))
        if not self.hot.search(codes):
            return b""
        n = np.bincount(np.frombuffer(codes, np.uint8), minlength=self.speaks.shape[1])
        return codes.translate(self.symbols[int(np.argmax(self.speaks @ n))])


def rewritten(clause: bytes) -> bytes:
    """The symbols of a clause after all transducers."""
    return bytes(reversed(BACKWARD.run(reversed(FORWARD.run(clause)))))


def matches(text: str, lexicon: _Lexicon) -> np.ndarray:
    """The summed clause weights of each class of ARCS in a text; in logs."""
    n = Counter()
    for clause in lexicon.read(text).split(b"E"):
        if _HOT.search(clause):
            n.update(rewritten(clause))
    return np.log1p(np.asarray([sum(w * n[x] for x, w in arcs.items()) for arcs in ARCS], float))


def learn_lexicon(texts: list[str], labels: list[int]) -> tuple[set[str], set[str], set[str]]:
    """(strong words, strong beginnings, weak beginnings) that mark toxic texts beyond chance. Strong ones hardly occur
    elsewhere; weak ones do, but several times less often a text. Of nested beginnings the most telling is
    taken, of equally telling ones the shortest."""
    seen, often = (Counter(), Counter()), (Counter(), Counter())
    for text, y in zip(texts, labels, strict=True):
        words = Counter(re.findall(r"[^\W\d_]+", text.lower()))
        stems = Counter()
        for w, n in words.items():
            for k in STEMS:
                if len(w) > k:
                    stems[w[:k] + "*"] += n
        seen[y].update(words.keys() | stems.keys())
        often[y].update(stems)
    total = (labels.count(0), labels.count(1))
    base = total[1] / max(1, sum(total))

    def ratio(w: str) -> float:
        pos, neg = seen[1][w], seen[0][w]
        share = pos / (pos + neg)
        if share <= base or not 0 < base < 1:
            return 0.0
        return 2 * (pos * math.log(share / base) + (neg * math.log((1 - share) / (1 - base)) if neg else 0))

    def rare(w: str) -> bool:
        return seen[0][w] <= 0.02 * seen[1][w]

    def repeated(w: str) -> bool:
        pos, neg = often[1][w] / seen[1][w], often[0][w] / max(1, seen[0][w])
        return pos >= 2 * neg and often[1][w] * total[0] >= 40 * often[0][w] * total[1]

    beyond = sorted((w for w in seen[1] if ratio(w) >= LEAST_RATIO), key=lambda w: (-ratio(w), len(w), w))

    def best(good) -> set[str]:
        out: set[str] = set()
        for w in beyond:
            stem = w[:-1]
            if w[-1] == "*" and good(w) and not any(x.startswith(stem) or stem.startswith(x) for x in out):
                out.add(stem)
        return out

    weak = best(lambda w: not rare(w) and repeated(w))
    held = lambda w: any(w[:n] in weak for n in STEMS)
    strong = {w for w in beyond if w[-1] != "*" and rare(w) and not held(w)}
    return strong, best(lambda w: rare(w) and not held(w)), weak


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression around PRIOR by Newton's method; non-negative but for the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = PRIOR.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + RIDGE * (w - PRIOR)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), slope)
        w[:-1] = np.maximum(w[:-1], 0)
    return w


def learn(docs: DataFrame, labels: DataFrame) -> tuple[tuple[set[str], set[str], set[str]], np.ndarray]:
    """The lexicon and the output weights."""
    texts, y = labelled_sample(docs, labels, "toxic", f"not ({HELD_OUT})", TRAIN_ROWS, TRAIN_CHARS)
    learned = learn_lexicon(texts, y)
    if not texts:
        return learned, PRIOR
    lexicon = _Lexicon(*learned)
    return learned, fit_weights(np.stack([matches(t, lexicon) for t in texts]), np.asarray(y, float))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    learned, weights = learn(docs, labels)

    def run(batches):
        lexicon = _Lexicon(*learned)
        for b in slices(batches):
            x = np.asarray([matches(t or "", lexicon) for t in b.column("text").to_pylist()]).reshape(b.num_rows, len(PRIOR) - 1)
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
