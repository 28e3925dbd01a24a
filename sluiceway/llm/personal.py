"""Personal data: patterns of form, and contexts learned from them by bootstrapping.

Plain forms (e-mail, IP, card and phone numbers) are found by patterns. These are the seeds. The words
around a seed make lexical patterns. A graph links each lexical pattern with every
identifier it surrounds, seed or not. Spark scores both sides in turns: a pattern is as reliable
as the identifiers that it surrounds, and an identifier that has no plain form
as the patterns around it. Reliable patterns then mark such identifiers as personal data, which
are seeds for further patterns in the next turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.staging import written

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SUPPORT = 3  # reliable identifiers that a pattern must surround
RELIABLE = 0.5  # score from which patterns and identifiers count
LONGEST = 254  # letters of an identifier
CONTEXT = 80  # letters on each side that are searched for words
SALTS = 16  # frequent patterns and identifiers are dealt to so many parts

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
# each run of digits starts at most one attempt, and no part gives letters back
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# identifiers without a plain form: numbers in groups, tokens with an @, addresses with colons, spelled-out @
_NUMBER = re.compile(r"(?<![A-Za-z0-9_])[+(]?[0-9](?:[().\x20-]*+[0-9])*+")
_LETTER = re.compile(r"[A-Za-z_]")
_TOKEN = re.compile(r"[A-Za-z0-9._%+@:-]++")
_SPELLED = re.compile(r"[\x20]?[\[(](?:at|AT)[\])][\x20]?")
_WORDS = re.compile(r"\w+|[^\w\s]")


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain, each letter looked at a fixed number of times."""
    free = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        # back to the first letter that is none of a local part, a growing piece at a time
        piece = 64
        while start > free:
            low = max(free, start - piece)
            other = [m.end() for m in _NOT_LOCAL.finditer(text, low, start)]
            start = low + (other[-1] - low) if other else low
            if other:
                break
            piece *= 2
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = at = domain.end()
        else:
            free = at = at + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) by kind, then start. Matches that fail their check are dropped."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m.group()) if m.end() - m.start() >= 16 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(1 for _ in _DIGIT.finditer(text, *m.span())) <= 15:
            out.append(("phone", *m.span()))
    return out


def _gaps(spans: list[tuple[str, int, int]], length: int) -> Iterator[tuple[int, int]]:
    at = 0
    for a, b in sorted((a, b) for _, a, b in spans):
        if a > at:
            yield at, a
        at = max(at, b)
    if at < length:
        yield at, length


def candidates(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """(start, stop, kinds) of identifiers beside the spans; kinds is a bit for each kind it could be.

    Numbers of 6 to 19 digits may be phones, of 12 or more cards, with three or more points addresses; tokens with an @, or with
    an @ spelled out in brackets, may be e-mails; tokens of digits, letters a to f and two or more colons
    addresses. Tokens of more than LONGEST letters are none of these.
    """
    out = []
    for a, b in _gaps(spans, len(text)):
        for m in _NUMBER.finditer(text, a, b):
            stop = m.end()
            digits = sum(1 for _ in _DIGIT.finditer(text, m.start(), stop))
            if 6 <= digits <= 19 and not _LETTER.match(text, stop):
                out.append((m.start(), stop, 8 | (4 if digits >= 12 else 0) | (2 if text.count(".", m.start(), stop) >= 3 else 0)))
        for m in _TOKEN.finditer(text, a, b):
            token = m.group().rstrip(".:-")
            if len(token) > LONGEST:
                continue
            if "@" in token:
                if len(token) > 2:
                    out.append((m.start(), m.start() + len(token), 1))
            elif token.count(":") >= 2 and re.fullmatch(r"[0-9A-Fa-f:.]+", token) and re.search(r"[0-9A-Fa-f]", token):
                out.append((m.start(), m.start() + len(token), 2))
        for m in _SPELLED.finditer(text, a, b):
            low = max(a, m.start() - CONTEXT)
            left = _LOCAL.search(text, low, m.start())
            right = _TOKEN.match(text, m.end(), min(b, m.end() + CONTEXT))
            if left and right:
                out.append((left.start(), m.end() + len(right.group().rstrip(".:-")), 1))
    return sorted(set(out))


def contexts(text: str, start: int, stop: int) -> list[str]:
    """Lexical patterns around a place: two or three words before it, or one on either side.

    Words are in lower case, marks are words, digits are 0. A place without words before it has none.
    """
    left = [w.lower() for w in _WORDS.findall(text, max(0, start - CONTEXT), start)][-3:]
    right = [w.lower() for w in _WORDS.findall(text, stop, min(len(text), stop + CONTEXT))][:1]
    if not left:
        return []
    found = [" ".join(left[-2:]) + " _"] if len(left) > 1 else [left[0] + " _"]
    if len(left) > 2:
        found.append(" ".join(left) + " _")
    if right:
        found.append(f"{left[-1]} _ {right[0]}")
    return [_DIGIT.sub("0", p) for p in found]


def instance(text: str) -> str:
    """What makes two mentions the same: letters in lower case and digits, without separators."""
    return re.sub(r"[^0-9a-z@]", "", text.lower())


_MENTION = "struct<kind:string,start:long,stop:long,kinds:int,instance:string,patterns:array<string>>"
_MENTIONS = pa.list_(
    pa.struct(
        [
            ("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("kinds", pa.int32()),
            ("instance", pa.string()), ("patterns", pa.list_(pa.string())),
        ]
    )
)


def _mentions(text: str) -> list[dict]:
    """Seeds with their kind, and candidates with null as kind, each with its contexts."""
    spans = base_spans(text)
    places = [(kind, a, b, 1 << KINDS.index(kind)) for kind, a, b in spans]
    places += [(None, a, b, kinds) for a, b, kinds in candidates(text, spans)]
    return [
        {"kind": kind, "start": a, "stop": b, "kinds": kinds, "instance": instance(text[a:b]), "patterns": contexts(text, a, b)}
        for kind, a, b, kinds in places
    ]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_mentions(t.as_py() or "") for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, _MENTIONS)], names=["doc_id", "mentions"]
        )


def _looked_up(big: DataFrame, small: DataFrame, key: str, spread: str) -> DataFrame:
    """Rows of ``big`` with the score of their key; a frequent key is dealt out by ``spread``."""
    salted = big.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    copies = small.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [key, "salt"], "left").drop("salt")


def _by_kind(f) -> Column:
    """An array with one entry for each kind."""
    return F.array(*(f(k) for k in range(len(KINDS))))


def pattern_graph(found: DataFrame) -> DataFrame:
    """``pattern``, ``instance``, ``seed`` (bits of kinds it has as a plain form), ``kinds`` (bits it could be).

    Each pattern and instance meet once, however often they do in the texts.
    """
    return (
        found.select(F.explode("mentions").alias("m"))
        .select(F.explode("m.patterns").alias("pattern"), "m.instance", "m.kind", "m.kinds")
        .groupBy("pattern", "instance")
        .agg(
            F.bit_or(F.when(F.col("kind").isNotNull(), F.col("kinds")).otherwise(0)).alias("seed"),
            F.bit_or("kinds").alias("kinds"),
        )
    )


def score_graph(edges: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT) -> DataFrame:
    """``pattern`` and ``scores``, one for each kind: the reliable patterns after all rounds.

    In a round a pattern's score for a kind is the sum of its instances' scores over one more than
    their number, and 0 with fewer than ``support`` reliable ones. A seed has 1, any other instance the
    mean over its patterns with a score, for the kinds that it could be.
    """
    has = lambda bits, k: F.col(bits).bitwiseAND(F.lit(1 << k)) != 0
    instances, patterns = None, None
    for turn in range(rounds):
        linked = edges if instances is None else _looked_up(edges, instances, "instance", "pattern")
        known = lambda k, first=turn == 0: F.when(has("seed", k), 1.0).otherwise(
            F.lit(0.0) if first else F.coalesce(F.get("value", F.lit(k)), F.lit(0.0))
        )
        sums = linked.groupBy("pattern").agg(
            F.count("*").alias("n"),
            *(F.sum(known(k)).alias(f"sum{k}") for k in range(len(KINDS))),
            *(F.count_if(known(k) >= RELIABLE).alias(f"n{k}") for k in range(len(KINDS))),
        )
        score = lambda k: F.when(F.col(f"n{k}") >= support, F.col(f"sum{k}") / (F.col("n") + 1)).otherwise(0.0)
        patterns = written(
            sums.select("pattern", _by_kind(score).alias("scores"))
            .where(F.exists("scores", lambda s: s > 0)),
            "patterns",
        )
        if turn + 1 < rounds:
            told = _looked_up(edges.where("seed = 0"), patterns, "pattern", "instance").where("scores is not null")
            part = lambda k: F.when(has("kinds", k), F.col("scores")[k])
            means = told.groupBy("instance").agg(
                *(F.sum(F.when(part(k) > 0, part(k))).alias(f"s{k}") for k in range(len(KINDS))),
                *(F.count_if(part(k) > 0).alias(f"c{k}") for k in range(len(KINDS))),
            )
            mean = lambda k: F.when(F.col(f"c{k}") > 0, F.col(f"s{k}") / F.col(f"c{k}")).otherwise(0.0)
            instances = written(means.select("instance", _by_kind(mean).alias("value")), "instances")
    return patterns.where(F.exists("scores", lambda s: s >= RELIABLE))


def find_personal_data(
    docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id`` and ``spans``: for each row its personal data as kind, start, stop, score and pattern.

    Starts and stops are code points, the stop exclusive. Plain forms have their kind, score 1 and no
    pattern; what a context tells has the kind with ``_context`` after it, the highest score among the
    reliable patterns around it (ties to the earlier kind, then the smaller pattern). A place that a context tells
    never overlaps a plain form. Spans are in the order of KINDS, plain forms first, then by start.

    A null or empty text has no spans. Every row is judged by its own text: rows that repeat an id stay rows of
    their own, and rows without an id count too. Repeated mentions of the same identifier in the same context
    count once. An empty table gives no rows. Other columns are dropped.
    """
    found = written(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(_scan, f"doc_id {docs.schema[id_col].dataType.simpleString()}, mentions array<{_MENTION}>")
        .withColumn("row", F.monotonically_increasing_id()),
        "mentions",
    )
    edges = written(pattern_graph(found), "graph")
    patterns = score_graph(edges, rounds, support)
    places = (
        found.select("row", F.explode(F.filter("mentions", lambda m: m["kind"].isNull())).alias("m"))
        .select("row", "m.start", "m.stop", "m.kinds", F.explode("m.patterns").alias("pattern"))
        .withColumn("place", F.struct("row", "start"))
    )
    told = _looked_up(places, patterns, "pattern", "place").where("scores is not null")
    best = F.array_max(
        F.filter(
            F.transform(
                F.sequence(F.lit(0), F.lit(len(KINDS) - 1)),
                lambda k: F.struct(
                    F.get("scores", k).alias("score"), (-k).alias("order"), F.col("pattern").alias("pattern"),
                ),
            ),
            lambda s: (s["score"] >= RELIABLE) & F.get(_by_kind(lambda k: F.col("kinds").bitwiseAND(F.lit(1 << k)) != 0), -s["order"]),
        )
    )
    places_told = (
        told.withColumn("best", best).where("best is not null")
        .groupBy("row", "start", "stop")
        .agg(F.max(F.struct(F.col("best.score").alias("score"), F.col("best.order").alias("order"))).alias("best"),
             F.min(F.struct((-F.col("best.score")).alias("s"), (-F.col("best.order")).alias("o"), F.col("best.pattern").alias("pattern"))).alias("first"))
        .groupBy("row")
        .agg(F.collect_list(F.struct(
            (F.lit(len(KINDS)) - F.col("best.order")).alias("order"), "start", "stop",
            F.col("best.score").alias("score"), F.col("first.pattern").alias("pattern"),
        )).alias("context"))
    )
    names = F.array(*(F.lit(k) for k in (*KINDS, *(f"{k}_context" for k in KINDS))))
    plain = F.transform(
        F.filter("mentions", lambda m: m["kind"].isNotNull()),
        lambda m: F.struct(
            (F.array_position(names, m["kind"]) - 1).cast("int").alias("order"), m["start"].alias("start"), m["stop"].alias("stop"),
            F.lit(1.0).alias("score"), F.lit(None).cast("string").alias("pattern"),
        ),
    )
    every = F.array_sort(F.concat(plain, F.coalesce("context", F.array().cast(
        "array<struct<order:int,start:bigint,stop:bigint,score:double,pattern:string>>"
    ))))
    return found.join(places_told, "row", "left").select(
        "doc_id",
        F.transform(every, lambda s: F.struct(
            F.get(names, s["order"]).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"),
            s["score"].alias("score"), s["pattern"].alias("pattern"),
        )).alias("spans"),
    )
