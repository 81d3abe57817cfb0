"""Personal data by weak supervision: labelers vote on candidate spans, and a span classifier learns from their votes.

Candidates are the base patterns' matches (also those whose checks fail) and wider forms: spelled-out or spaced e-mail
addresses, local phone numbers, identity numbers. Five labelers vote for, against or not at all: the kind's exact check,
a gazetteer (top-level domains, reserved networks, card issuers, country codes), context words before the span, the
span's edges, and the variety of its characters. Votes are counted by pattern over all documents; expectation-maximisation
on that table of bounded size estimates each labeler's reliability and each pattern's probability; these train a naive
Bayes classifier over span features, which accepts further spans. Base spans always stay.

DataFrame functions only. What comes back to the driver are tables whose sizes are bounded by the numbers of kinds,
labelers, patterns and feature values. Null texts are empty and have no spans; rows are independent, so repeated rows
have equal results; without candidates no span is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideflow.llm import spans as S
from tideflow.llm.common import checkpointed

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "id")
LABELERS = 5
#: How reliable the labelers are taken to be before any votes are seen; as much as ten votes.
BELIEF = (0.9, 0.8, 0.9, 0.6, 0.6)
#: The labeler of context words, the only one that can tell a look-alike (an order's number) of the same form.
CONTEXT = 2
ROUNDS = 25
#: Gazetteers.
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "uk", "us", "it", "nl", "at", "ch", "co")
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9])|35)"
CUES = {
    "email": r"(?:e-?mail|correo|courriel|contact|kontakt|write|an:|to:|from:)",
    "ip": r"(?:\bip\b|host|server|address|client|adresse|from)",
    "card": r"(?:card|visa|master|amex|karte|carte|tarjeta|credit)",
    "phone": r"(?:phone|call|tel|mobil|fax|ruf|appel|llam)",
    "id": r"(?:ssn|social|passport|ausweis|identity|dni|id)",
}
AGAINST = r"(?:version|v\.|order|invoice|isbn|page|section|build|release|bestell|commande|pedido)[ #:.]*$"


def _base(text: Column) -> Column:
    """The base patterns' matches, before their checks."""
    # A long run is entered at its start only, and runs are taken whole; the matches are those of the plain patterns.
    email = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
    ip = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
    # Separators inside a card number become a mark, so that the whole number is one run of a character class.
    mark = "\u0001"
    marked = F.regexp_replace(F.translate(text, mark, "\u0002"), r"(?<=[0-9])[\x20-](?=[0-9])", mark)
    return F.concat(
        S.matches(text, email, "email", F.contains(text, F.lit("@"))),
        S.matches(text, ip, "ip", text.rlike(r"[0-9]\.[0-9]++\.[0-9]")),
        S.matches(text, f"[0-9][0-9{mark}]+", "card", text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), in_text=marked),
        S.matches(text, r"\+[0-9][\x20().0-9-]+[0-9]", "phone", F.contains(text, F.lit("+"))),
    )


def _wide(text: Column) -> Column:
    """Further candidates."""
    email = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\)|@)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]{2,63}+){1,4}"
    phone = r"(?<![0-9+)])(?<![0-9)][\x20.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
    id_ = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
    return F.concat(
        S.matches(text, email, "email", text.rlike(r"\[at\]|\(at\)|\x20@|@\x20")),
        S.matches(text, phone, "phone", text.rlike(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}")),
        S.matches(text, id_, "id", text.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")),
    )


def luhn(number: Column) -> Column:
    n = F.length(number)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(number, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _checked(s: Column) -> Column:
    """Whether a base match passes its kind's check."""
    number = S.digits(s["match"])
    n = F.length(number)

    def byte(part: Column) -> Column:
        short = F.ltrim(part, F.lit("0"))
        return F.when(F.length(short) <= 3, F.coalesce(short.try_cast("int"), F.lit(0))).otherwise(256) <= 255

    return (
        F.when(s["kind"] == "ip", F.forall(F.split(s["match"], r"\."), byte))
        .when(s["kind"] == "card", n.between(12, 19) & F.when(n.between(12, 19), luhn(number)).otherwise(False))
        .when(s["kind"] == "phone", n.between(9, 15))
        .otherwise(True)
    )


def base_spans(text: Column) -> Column:
    return S.keep(_base(text), _checked)


def _before(s: Column, text: Column) -> Column:
    """The 40 characters before a span, lower-cased."""
    return F.lower(F.substring(text, F.greatest(s["start"] - 39, F.lit(1)), F.least(s["start"], F.lit(40))))


def _context(s: Column, text: Column) -> Column:
    """1 after a cue of the span's kind, -1 after one against it, else 0."""
    before = _before(s, text)
    cue = F.lit(False)
    for k, words in CUES.items():
        cue = cue | ((s["kind"] == k) & before.rlike(words))
    return F.when(before.rlike(AGAINST), -1).when(cue, 1).otherwise(0)


def _votes(s: Column, text: Column) -> Column:
    """The labelers' votes on a candidate: 1 for, -1 against, 0 not at all."""
    kind, match = s["kind"], s["match"]
    before = _before(s, text)
    after = F.substring(text, s["end"] + 1, F.lit(1))
    number = S.digits(match)

    def vote(yes: Column, no: Column | None = None) -> Column:
        return F.when(yes, 1).when(~yes if no is None else no, -1).otherwise(0)

    exact = F.when(kind == "id", 0).when(kind == "email", vote(match.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+$"), F.lit(False))).when(kind == "phone", vote(match.rlike(r"^\+") & F.length(number).between(9, 15), match.rlike(r"^\+"))).otherwise(vote(_checked(s)))
    known = (
        F.when(kind == "email", vote(F.lower(F.element_at(F.split(match, r"\.|\x20|\)|\]"), -1)).isin(*TOP_LEVEL)))
        .when(kind == "ip", vote(~match.rlike(r"^(?:0|127|255)\."), match.rlike(r"^(?:0|127|255)\.")))
        .when(kind == "card", vote(number.rlike(ISSUERS)))
        .when(kind == "phone", vote(match.rlike(COUNTRY), match.rlike(r"^\+")))
        .otherwise(vote(match.rlike("^(?!000|666|9)"), match.rlike("^(?:000|666|9)")))
    )
    context = _context(s, text)
    edge = r"^$|^[^0-9A-Za-z_]$"
    edges = vote(F.coalesce(F.substring(before, -1, 1), F.lit("")).rlike(edge) & after.rlike(edge))
    variety = vote(F.size(F.array_distinct(F.split(match, ""))) >= F.when(kind == "ip", 3).otherwise(5))
    return F.array(exact, known, context, edges, variety)


def _features(s: Column, text: Column) -> Column:
    """A candidate's feature values, each kind:feature:value."""
    match, number = s["match"], S.digits(s["match"])
    before = F.substring(text, s["start"], F.when(s["start"] > 0, 1).otherwise(0))
    after = F.substring(text, s["end"] + 1, F.lit(1))
    kind = F.when(before.rlike("[0-9]"), "digit").when(before.rlike("[A-Za-z]"), "letter").when(before == "", "none").otherwise("other")
    next_ = F.when(after.rlike("[0-9]"), "digit").when(after.rlike("[A-Za-z]"), "letter").when(after == "", "none").otherwise("other")
    values = [
        F.concat(F.lit("length="), F.least(F.floor(F.length(match) / 4), F.lit(12)).cast("string")),
        F.concat(F.lit("digits="), F.floor(F.length(number) * 5 / F.length(match)).cast("string")),
        F.concat(F.lit("before="), kind),
        F.concat(F.lit("after="), next_),
        F.concat(F.lit("context="), _context(s, text).cast("string")),
        F.concat(F.lit("shape="), F.when(match.rlike(r"^\+"), "plus").when(match.rlike(r"\x20"), "spaced").when(match.rlike("-"), "dashed").otherwise("plain")),
    ]
    return F.array(*[F.concat_ws(":", s["kind"], v) for v in values])


def reliabilities(patterns: DataFrame) -> DataFrame:
    """kind, model (prior, hit, miss): EM on (kind, votes, n). hit: P(vote for | personal), miss: P(vote for | not).

    Context is never taken to be less reliable than believed: where all other labelers see one form, EM would learn from them
    that its votes against mean nothing.
    """
    packed = patterns.groupBy("kind", "votes").agg(F.sum("n").cast("double").alias("n")).groupBy("kind").agg(F.collect_list(F.struct("votes", "n")).alias("p"))
    start = F.struct(F.lit(0.5).alias("prior"), F.array(*[F.lit(x) for x in BELIEF]).alias("hit"), F.array(*[F.lit(1 - x) for x in BELIEF]).alias("miss"))

    def step(m: Column, _: Column) -> Column:
        weighed = F.transform(F.col("p"), lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), (x["n"] * _posterior(m, x["votes"])).alias("w")))

        def total(f) -> Column:
            return F.aggregate(weighed, F.lit(0.0), lambda a, x: a + f(x))

        def rate(j: int, of: str, good: float, bad: float) -> Column:
            weight = (lambda x: x["w"]) if of == "hit" else (lambda x: x["n"] - x["w"])
            yes = total(lambda x: F.when(x["votes"][j] == 1, weight(x)).otherwise(0.0))
            any_ = total(lambda x: F.when(x["votes"][j] != 0, weight(x)).otherwise(0.0))
            return (yes + good) / (any_ + good + bad)

        def anchored(j: int, of: str) -> Column:
            good, bad = (BELIEF[j], 1 - BELIEF[j]) if of == "hit" else (1 - BELIEF[j], BELIEF[j])
            learned = rate(j, of, 10 * good, 10 * bad)
            if j != CONTEXT:
                return learned
            return F.greatest(learned, F.lit(good)) if of == "hit" else F.least(learned, F.lit(good))

        prior = (total(lambda x: x["w"]) + 2) / (total(lambda x: x["n"]) + 4)
        return F.struct(prior.alias("prior"), *[F.array(*[anchored(j, of) for j in range(LABELERS)]).alias(of) for of in ("hit", "miss")])

    return packed.select("kind", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step).alias("model"))


def _posterior(model: Column, votes: Column) -> Column:
    yes, no = model["prior"], 1 - model["prior"]
    for j in range(LABELERS):
        v = votes[j]
        yes = yes * F.when(v == 1, model["hit"][j]).when(v == -1, 1 - model["hit"][j]).otherwise(1.0)
        no = no * F.when(v == 1, model["miss"][j]).when(v == -1, 1 - model["miss"][j]).otherwise(1.0)
    return yes / (yes + no)


def classifier(docs: DataFrame) -> dict[str, float]:
    """Log-odds by feature value, and by kind for the prior; at most a few hundred entries."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select(text.alias("text")).select("text", F.explode(F.concat(_base(F.col("text")), _wide(F.col("text")))).alias("s"))
    counted = found.select("s.kind", _votes(F.col("s"), F.col("text")).alias("votes"), _features(F.col("s"), F.col("text")).alias("features"))
    patterns = checkpointed(counted.groupBy("kind", "votes", "features").agg(F.count("*").alias("n")))
    soft = patterns.join(F.broadcast(reliabilities(patterns)), "kind").select("kind", "features", "n", _posterior(F.col("model"), F.col("votes")).alias("p"))
    soft = checkpointed(soft)
    whole = soft.groupBy("kind").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no"))
    each = soft.select("kind", F.explode("features").alias("feature"), "n", "p").groupBy("kind", "feature").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no"))
    odds = each.join(F.broadcast(whole.withColumnsRenamed({"yes": "all_yes", "no": "all_no"})), "kind").select("feature", (F.log((F.col("yes") + 1) / (F.col("all_yes") + 4)) - F.log((F.col("no") + 1) / (F.col("all_no") + 4))).alias("odds"))
    odds = odds.unionByName(whole.select(F.col("kind").alias("feature"), F.log((F.col("yes") + 1) / (F.col("no") + 1)).alias("odds")))
    return {r["feature"]: r["odds"] for r in odds.collect()}


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, for each row of docs.

    docs has doc_id and text; other columns are ignored.
    """
    odds = classifier(docs)
    text = F.col("text")
    base = base_spans(text)
    if odds:
        table = F.create_map(*[x for k, v in sorted(odds.items()) for x in (F.lit(k), F.lit(float(v)))])

        def accepted(s: Column) -> Column:
            score = F.aggregate(_features(s, text), F.coalesce(table[s["kind"]], F.lit(-1.0)), lambda a, f: a + F.coalesce(table[f], F.lit(0.0)))
            return score > 0

        # What a base span covers isn't told again as a wider one.
        more = F.filter(_wide(text), lambda s: accepted(s) & ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    else:
        more = F.filter(_wide(text), lambda s: F.lit(False))
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("base", base).withColumn("every", F.concat("base", more))
    return out.select("doc_id", *[S.count_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE], F.sha2(S.told(F.col("base"), KINDS), 256).alias("base_sha256"), S.told(F.col("every"), KINDS).alias("spans"))
