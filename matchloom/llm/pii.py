"""Personal data by weak supervision.

Regexes propose candidate spans: the strict base kinds and looser ones, names, addresses and dates of birth among them.
On each candidate, labelers vote yes, no or abstain: the kind's own checks, gazetteers, words of the context for and
against it, other candidates close by, and for names their use elsewhere: how often the corpus has the same given or
family name with evidence for and against a person. A name that no list has is no evidence, so lists are no bound on what is
found. Expectation-maximisation over the counts of each kind's vote patterns in the whole corpus estimates how reliable its
labelers are, those of the base kinds too (``reliabilities``). The posteriors then train a logistic span classifier that sees the
votes, the span's shape and hashed words around it, on a sample of at most about ``TRAIN_SPANS`` candidates. Base spans
always stay; others stay at 0.5 or more.

Defined results: a null or empty text has no spans. Positions are code points, end exclusive. Repeated rows are
scanned row by row and count as often in the estimates; null doc_ids pass through; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import cut, map_batches, read_table, replicated, spread

BASE_KINDS = ("email", "ip", "card", "phone")
#: In the order in which kinds are listed.
KINDS = (*BASE_KINDS, "spelled_email", "local_phone", "national_id", "iban", "person", "address", "birth_date")
#: The bound of the classifier's sample, and the number of hashed features.
TRAIN_SPANS, DIM = 20_000, 1 << 12
_ADDRESSES = re.compile(r"[A-Za-z0-9._%+@-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = {
    "spelled_email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}\s?[\[(]\s?(?:at|AT)\s?[\])]\s?[A-Za-z0-9-]{2,63}(?:\s?(?:[\[(]\s?(?:dot|DOT)\s?[\])]|\.)\s?[A-Za-z]{2,24})+"),
    "local_phone": re.compile(r"(?<![\w+.(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![\w-])"),
    "national_id": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)"),
    "birth_date": re.compile(r"(?<![\w./-])(?:[0-9]{1,2}([./-])[0-9]{1,2}\1(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![\w/-])"),
    "address": re.compile(
        r"(?<!\w)(?:[0-9]{1,5}[a-z]?,?\x20(?:[A-ZÄÖÜÉ][\w'-]+\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Square)\b\.?"
        r"|[A-ZÄÖÜ][\w-]+(?:straße|strasse|weg|platz|allee|gasse)\x20[0-9]{1,4}[a-z]?"
        r"|(?:[0-9]{1,4},?\x20)?(?:[Rr]ue|[Aa]venida|[Cc]alle|[Pp]laza)\x20(?:(?:de|du|des|la|del|los)\x20){0,2}[A-ZÉÁ][\w'-]+(?:,?\x20[0-9]{1,4})?)(?!\w)"
    ),
    "person": re.compile(r"(?<![\w@.-])(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Señora?|Sra?)\.?\x20)?(?!(?:Dear|Hello|Hi|The|This|From|To|On|In|At|And|But|If|When|Signed|Name|Liebe|Lieber|Cher|Chère|Estimad[oa])\x20)[A-ZÀ-Ý][a-zß-ÿ]+(?:-[A-ZÀ-Ý][a-zß-ÿ]+)?\x20(?:[A-Z]\.\x20)?[A-ZÀ-Ý][a-zß-ÿ]+(?:-[A-ZÀ-Ý][a-zß-ÿ]+)?(?!\w)"),
}
_DIGIT, _CAPITALS = re.compile(r"[0-9]"), re.compile(r"[A-ZÀ-Ý][a-zß-ÿ]+[-\w]*\x20(?:[A-Z]\.\x20)?[A-ZÀ-Ý]")
_TITLE = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Señora?|Sra?)\.?\x20")


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


@dataclass(frozen=True)
class Gazetteers:
    """Lists the gazetteer labeler looks up. Callers with larger tables ``read`` their own; these are small defaults."""

    endings: frozenset[str] = _words("com org net edu gov io de fr es uk it nl eu info biz")
    iban_countries: frozenset[str] = _words("AD AT BE CH CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE")
    area_codes: frozenset[str] = _words("201 202 203 206 212 213 214 215 301 303 305 310 312 313 314 404 407 408 410 412 415 416 425 503 504 510 512 602 604 612 617 619 650 702 703 713 718 720 732 770 773 801 805 817 818 847 858 901 904 908 916 917 919 925 949 954 972 973")
    given: frozenset[str] = _words(
        "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Lisa Daniel Nancy "
        "Matthew Betty Anthony Sandra Mark Margaret Paul Ashley Steven Kimberly Andrew Emily Kenneth Donna George Michelle Emma Olivia Peter Anna Maria Laura Hans Klaus Jürgen Wolfgang "
        "Stefan Sabine Petra Monika Ursula Heike Jean Pierre Marie Jacques Claire Sophie Camille Luc Nicolas Isabelle José Juan Carlos Luis Carmen Ana Lucía Javier Pablo Elena"
    )


    @classmethod
    def read(cls, table: DataFrame, most: int = 200_000) -> Gazetteers:
        """The lists of a table (list, value), where it has them; a table of over ``most`` rows is an error, as every task holds it."""
        rows = table.select("list", "value").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"over {most} gazetteer rows")
        found: dict[str, set[str]] = {}
        for r in rows:
            found.setdefault(r["list"], set()).add(r["value"])
        return cls(**{k: frozenset(v) for k, v in found.items()})


#: Context words that speak for or against a kind of data, in the forty characters before a span.
FOR = {
    "email": re.compile(r"(?i)e-?mail|contact|write|correo|courriel"),
    "spelled_email": re.compile(r"(?i)e-?mail|contact|write|correo|courriel"),
    "ip": re.compile(r"(?i)\bip\b|address|host|server|login"),
    "card": re.compile(r"(?i)card|visa|credit|karte|carte|tarjeta"),
    "phone": re.compile(r"(?i)phone|tel|call|mobile|fax|anruf"),
    "local_phone": re.compile(r"(?i)phone|tel|call|mobile|fax|anruf"),
    "national_id": re.compile(r"(?i)ssn|social|tax|\bid\b"),
    "iban": re.compile(r"(?i)iban|account|konto|compte|cuenta"),
    "birth_date": re.compile(r"(?i)born|birth|\bdob\b|geboren|geburt|\bnée?\b|naissance|nacid[oa]|nacimiento"),
    "address": re.compile(r"(?i)address|lives? (?:at|in)|living|reside|home|ship to|deliver|wohn|anschrift|adresse|habite|vive en|domicilio"),
    "person": re.compile(r"(?i)\bname|signed|sincerely|regards|dear|contact|patient|customer|employee|met with|spoke|called|born|author|herr|frau|señor|madame|monsieur"),
}
AGAINST = {
    "person": re.compile(r"(?i)university|company|river|lake|mount|new |county|street|city of|the $|saint |\b(?:in|near|at|across|outside|around|toward|towards|visit|visited|trip to|flight to|flew to) $"),
    "address": re.compile(r"(?i)chapter|section|page|figure|score|version"),
    "birth_date": re.compile(r"(?i)publish|release|updated|version|accessed|retrieved|printed|invoice|order|expires?|due|deadline|copyright|edition"),
}
_AGAINST_ANY = re.compile(r"(?i)version|release|build|order|invoice|isbn|issn|example|page|section|chapter")
LABELERS = ("checks", "gazetteer", "context", "counter_context", "neighbours", "usage")
#: What follows a span and speaks for a person.
_ACTS = re.compile(r"(?i),?\x20(?:replied|called|told|asked|wrote|writes|smiled|phoned|answered|nodded|lives|lived|moved|was\x20born|is\x20married|and\x20(?:his|her)\b|['’]s\x20(?:wife|husband|mother|father|son|daughter|phone|email|account|passport))")
#: Words in or right after a span that name a place or an organisation, and first words that do.
_ORG = re.compile(r"(?:^|\x20)(?:Airlines?|Airport|Academy|Association|Avenue|Bank|Bay|Beach|Bridge|Bureau|Canyon|Castle|Church|City|Club|College|Committee|Company|Corp|Corporation|Council|County|Court|Creek|Department|District|Falls|Forest|Foundation|GmbH|Group|Harbou?r|Heights|Hills?|Holdings|Hospital|Hotel|Inc|Industries|Institute|Island|Islands|Labs?|Lake|Library|Limited|Llc|Ltd|Mall|Ministry|Mountains?|Museum|Ocean|Park|Partners|Peninsula|Plaza|Port|Press|Ranch|Republic|River|Road|School|Sea|Services|Society|Software|Solutions|Square|States?|Station|Street|Studios?|Systems|Technologies|Theat(?:er|re)|Times|Tower|Town|Union|University|Valley|Village|Works)(?![a-z])")
_PLACE = re.compile(r"(?:New|North|South|East|West|Northern|Southern|Eastern|Western|San|Santa|Saint|Los|Las|El|Port|Fort|Mount|Lake|Cape|Great|Upper|Lower|Central|Royal|United|National|General|Bank|Grand|Old|Little|Rio|Costa|Puerto|Buenos|Hong|Tel|Abu|Sri|Bad)\x20")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in time linear in the text: every @ is tried once, with all before it since the last."""
    out = []
    for run in _ADDRESSES.finditer(text):
        if "@" not in run[0]:
            continue
        start, at = run.start(), text.find("@", run.start(), run.end())
        while at >= 0:
            stop = m.end() if at > start and (m := _DOMAIN.match(text, at + 1, run.end())) else 0
            if stop:
                out.append((start, stop))
            start = stop or at + 1
            at = text.find("@", start, run.end())
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each base kind, failing ones dropped without a retry."""
    out = []
    if "@" in text:
        out += [(*s, "email") for s in emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    if "+" in text:
        out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def _merged(spans) -> list[tuple[int, int]]:
    """Disjoint intervals, in order, that cover the spans."""
    out: list[tuple[int, int]] = []
    for a, b, *_ in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def loose_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Looser candidates that don't overlap a base span; of overlapping ones the kind listed first counts."""
    out: list[tuple[int, int, str]] = []
    digits, brackets, capitals = _DIGIT.search(text), "[" in text or "(" in text, _CAPITALS.search(text)
    if not (digits or brackets or capitals):
        return out
    ends = _merged(taken)
    for kind, pattern in _LOOSE.items():
        if not (capitals if kind == "person" else brackets or digits):
            continue
        fresh = []
        for m in pattern.finditer(text):
            i = bisect_left(ends, (m.end(),))
            if not i or ends[i - 1][1] <= m.start():
                fresh.append((*m.span(), kind))
        out += fresh
        if fresh:
            ends = _merged([*ends, *fresh])
    return out


def _iban_checks(value: str) -> bool:
    v = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _valid_date(value: str) -> bool:
    parts = [int(p) for p in re.split(r"[./-]", value)]
    year, a, b = (parts[0], *parts[1:]) if parts[0] > 999 else (parts[2], *parts[:2])
    return 1900 <= year <= 2020 and 1 <= min(a, b) <= 12 and max(a, b) <= 31 and min(a, b) >= 1


def votes(text: str, start: int, stop: int, kind: str, near: bool, lists: Gazetteers) -> str:
    """One of y, n, - for each labeler. ``near``: another candidate is close by."""
    value, before = text[start:stop], text[max(0, start - 40) : start].rsplit("\n", 1)[-1]
    checks, listed = "-", None
    if kind == "email":
        listed = value.rsplit(".", 1)[1].lower() in lists.endings
    elif kind == "spelled_email":
        checks, listed = "y" if "dot" in value.lower() else "-", re.split(r"[\s.\])]+", value.rstrip("])"))[-1].lower() in lists.endings
    elif kind == "ip":
        checks = "n" if value.startswith(("0.", "127.", "255.")) else "y"
    elif kind == "card":
        checks, listed = "y", value[0] in "3456"
    elif kind == "iban":
        checks, listed = "y" if _iban_checks(value) else "n", value[:2] in lists.iban_countries
    elif kind == "national_id":
        checks = "n" if value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" or value[7:] == "0000" else "y"
    elif kind in ("phone", "local_phone"):
        digits = "".join(c for c in value if c in "0123456789")
        checks = "n" if len(set(digits)) == 1 else "y" if kind == "phone" else "-" if digits[0] not in "01" and digits[3] not in "01" else "n"
        listed = True if kind == "local_phone" and digits[:3] in lists.area_codes else None
    elif kind == "birth_date":
        checks = "-" if _valid_date(value) else "n"
    elif kind == "address":
        checks = "y" if re.match(r"[\s,]*(?:[A-Za-z]{0,2}[- ]?)?[0-9]{5}(?![0-9])|,\x20[A-ZÀ-Ý][a-zß-ÿ]+", text[stop : stop + 12]) else "-"
    else:
        bare = _TITLE.sub("", value, count=1)
        tail = re.match(r"(?:\x20[A-Z][\w&.]*){0,2}", text[stop : stop + 40])[0]
        checks = "y" if len(bare) < len(value) else "n" if _ORG.search(bare + tail) or _PLACE.match(bare) else "-"
        listed = True if re.split(r"[\x20-]", bare)[0] in lists.given else None
    gazetteer = "-" if listed is None else "y" if listed else "n"
    after = kind == "person" and _ACTS.match(text, stop)
    context = "y" if after or FOR[kind].search(before) else "n" if kind == "birth_date" else "-"
    against = AGAINST.get(kind, _AGAINST_ANY).search(before)
    return checks + gazetteer + context + ("n" if against else "-") + ("y" if near else "-")


def _hash(text: str) -> int:
    return xxhash.xxh32_intdigest(text) % DIM


_TOKEN = re.compile(r"\w+|[^\w\s]")


def span_features(text: str, start: int, stop: int, kind: str, votes_: str) -> list[int]:
    """Hashed features: the votes with their kind, the span's shape, and three words on either side with their places."""
    shape = re.sub(r"(.)\1+", r"\1+", re.sub(r"[a-zß-ÿ]", "a", re.sub(r"[A-ZÀ-Ý]", "A", re.sub(r"[0-9]", "9", text[start:stop]))))
    left, right = _TOKEN.findall(text[max(0, start - 60) : start])[-3:], _TOKEN.findall(text[stop : stop + 60])[:3]
    out = [f"kind {kind}", f"shape {kind} {shape[:24]}", f"size {kind} {min(stop - start, 40) // 4}"]
    out += [f"vote {kind} {i} {v}" for i, v in enumerate(votes_)]
    out += [f"left {kind} {i} {w.lower()}" for i, w in enumerate(reversed(left))] + [f"right {kind} {i} {w.lower()}" for i, w in enumerate(right)]
    return [_hash(x) for x in out]


def names_of(value: str) -> list[str]:
    """The given and the family name of a person's span, without its title and with their roles."""
    words = _TITLE.sub("", value, count=1).split(" ")
    return [f"given {words[0]}", f"family {words[-1]}"]


def candidates(docs: DataFrame, lists: Gazetteers = Gazetteers()) -> DataFrame:
    """doc_id and its candidate spans with their labelers' votes, the classifier's features, and the words of names."""
    item = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("votes", pa.string()), ("x", pa.list_(pa.int32())), ("names", pa.list_(pa.string()))])

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                t = t or ""
                base = base_spans(t)
                spans = sorted(base + loose_spans(t, base), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                row = []
                for k, (i, j, kind) in enumerate(spans):
                    near = k > 0 and i - spans[k - 1][1] <= 60 or k + 1 < len(spans) and spans[k + 1][0] - j <= 60
                    v = votes(t, i, j, kind, near, lists)
                    row.append({"start": i, "stop": j, "kind": kind, "votes": v, "x": span_features(t, i, j, kind, v) if kind not in BASE_KINDS else [], "names": names_of(t[i:j]) if kind == "person" else []})
                rows.append(row)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(item))], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, spans {_CANDIDATES}")


_CANDIDATES = "array<struct<start:int,stop:int,kind:string,votes:string,x:array<int>,names:array<string>>>"


def used_elsewhere(found: DataFrame) -> DataFrame:
    """``found`` (doc_id, spans) with the vote of the usage labeler and its feature on every span.

    A name's given and family words are counted over all candidates of the corpus: those with some vote for and none against
    by checks, gazetteer or context, and those with some vote against and none for. A word with two or more of one sort and
    twice as many as of the other votes that way; the span's own vote is not counted. Words that vote neither way for anyone
    need no join; the others meet their spans dealt to several tasks, as one name may be very common.
    """
    rows = cut(found.withColumn("rid", F.monotonically_increasing_id()))
    each = rows.select("rid", F.posexplode("spans").alias("i", "s")).where("s.kind = 'person'").select("rid", "i", F.explode("s.names").alias("name"), F.substring("s.votes", 1, 4).alias("v"))
    for_, against = F.col("v").contains("y"), F.col("v").contains("n")
    each = each.withColumns({"p": (for_ & ~against).cast("int"), "n": (against & ~for_).cast("int")})
    counts = each.groupBy("name").agg(F.sum("p").alias("ps"), F.sum("n").alias("ns")).where("greatest(ps, ns) >= 2")
    p, n = F.col("ps") - F.col("p"), F.col("ns") - F.col("n")
    side = F.when((p >= 2) & (p >= 2 * n), 1).when((n >= 2) & (n >= 2 * p), -1).otherwise(0)
    met = each.withColumn("part", spread("rid")).join(replicated(counts, "part"), ["name", "part"]).select("rid", "i", side.alias("side"))
    sides = met.groupBy("rid", "i").agg(F.sum("side").alias("side")).where("side <> 0")
    by_row = sides.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("i", "side"))).alias("sides"))  # spans of one text
    vote = lambda sides, i: F.coalesce(F.when(sides[i] > 0, "y").when(sides[i] < 0, "n"), F.lit("-"))
    marks = {v: _hash(f"vote person {len(LABELERS) - 1} {v}") for v in "yn-"}

    def voted(s, i):
        v = F.when(s["kind"] == "person", vote(F.coalesce("sides", F.create_map().cast("map<int,bigint>")), i)).otherwise("-")
        mark = F.when(v == "y", marks["y"]).when(v == "n", marks["n"]).otherwise(marks["-"])
        x = F.when(s["kind"] == "person", F.array_append(s["x"], mark)).otherwise(s["x"])
        return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), F.concat(s["votes"], v).alias("votes"), x.alias("x"))

    return rows.join(by_row, "rid", "left").select("doc_id", F.transform("spans", voted).alias("spans"))


def estimate(patterns: list[tuple[str, int]], rounds: int = 50, most_prior: float = 0.98) -> tuple[dict[str, float], float, np.ndarray]:
    """EM for two classes over (votes, count). Returns each pattern's posterior, the prior and the labelers' accuracies.

    Accuracies start, and without much evidence stay, at 0.8. The prior, which is what a candidate gets that no labeler
    votes on, is at most ``most_prior``.
    """
    V = np.array([[{"y": 1, "n": -1, "-": 0}[c] for c in p] for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    prior, acc = min(0.5, most_prior), np.full(V.shape[1], 0.8)
    post = np.full(len(n), 0.5)
    for _ in range(rounds):
        lo = np.log(prior / (1 - prior)) + V @ np.log(acc / (1 - acc))
        post = 1 / (1 + np.exp(-lo))
        prior = np.clip((post @ n + 4) / (n.sum() + 10), 0.02, most_prior)
        for j in range(V.shape[1]):
            right = n @ np.where(V[:, j] > 0, post, np.where(V[:, j] < 0, 1 - post, 0))
            acc[j] = np.clip((right + 8) / (n @ (V[:, j] != 0) + 10), 0.65, 0.99)
    return {p: float(q) for (p, _), q in zip(patterns, post)}, float(prior), acc


def fit_classifier(rows: list[tuple[list[int], float]], steps: int = 200, rate: float = 0.5, l2: float = 1e-4) -> np.ndarray:
    """Weights of the hashed features by AdaGrad over (features, posterior)."""
    w, g2 = np.zeros(DIM), np.full(DIM, 1e-8)
    if not rows:
        return w
    at = np.repeat(np.arange(len(rows)), [len(x) for x, _ in rows])
    flat, y = np.concatenate([x for x, _ in rows]).astype(int), np.array([q for _, q in rows])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[flat], len(rows)), -30, 30)))
        g = np.bincount(flat, (p - y)[at], DIM) / len(rows) + l2 * w
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
    return w


def estimates(found: DataFrame) -> dict[str, tuple[dict[str, float], float, np.ndarray, int]]:
    """For each kind, base ones too: the posterior of each vote pattern, the prior, the labelers' accuracies, and its candidates."""
    groups: dict[str, list[tuple[str, int]]] = {}
    # kinds x votes: at most 11 x 3^6 groups
    for r in found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").agg(F.count("*").alias("n")).collect():
        groups.setdefault(r.kind, []).append((r.votes, r.n))
    return {kind: (*estimate(sorted(g), most_prior=0.98 if kind in BASE_KINDS else 0.45), sum(n for _, n in g)) for kind, g in sorted(groups.items())}


def reliabilities(found: DataFrame) -> DataFrame:
    """kind, labeler, accuracy, the kind's prior and number of candidates: what the estimates say of every labeler."""
    rows = [(kind, name, float(a), prior, n) for kind, (_, prior, acc, n) in estimates(found).items() for name, a in zip(LABELERS, acc)]
    return found.sparkSession.createDataFrame(rows, "kind string, labeler string, accuracy double, prior double, n_candidates long")


def train(found: DataFrame, most: int = TRAIN_SPANS) -> np.ndarray:
    """The classifier's weights from the candidates in ``found``: EM over all vote counts, then a fit on the sample."""
    each = found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*").where(~F.col("kind").isin(*BASE_KINDS))
    known = {kind: x for kind, x in estimates(found).items() if kind not in BASE_KINDS}
    total = sum(x[3] for x in known.values())
    if not total:
        return np.zeros(DIM)
    posterior = {(kind, v): q for kind, x in known.items() for v, q in x[0].items()}
    u = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "start", "stop", "kind"), F.lit(1_000_000))
    sample = each.where(u < int(1_000_000 * min(1.0, most / total)) + 1).select("kind", "votes", "x").collect()
    return fit_classifier(sorted((list(r.x), posterior[r.kind, r.votes]) for r in sample))


def find(docs: DataFrame, lists: Gazetteers = Gazetteers()) -> DataFrame:
    """doc_id and spans (start, stop, kind) of every row of ``docs``."""
    found = cut(used_elsewhere(candidates(docs, lists)))
    weights = found.sparkSession.sparkContext.broadcast(train(found))
    item = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())])

    def judge(batches):
        for b in batches:
            rows = [[{k: s[k] for k in ("start", "stop", "kind")} for s in spans if s["kind"] in BASE_KINDS or weights.value[s["x"]].sum() >= 0] for spans in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(item))], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(found, judge, f"doc_id {kind}, spans array<struct<start:int,stop:int,kind:string>>")


def render(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of_kind(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return find(read_table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(render(of_kind(*BASE_KINDS)), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"))
