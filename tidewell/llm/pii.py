"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds. All native.

Four base kinds come from patterns with exact checks and always stay. Further generators propose spans that may
overlap; every proposal gets features of its form and of the words around it, computed as SQL expressions, and a score
from boosted trees that are written out as CASE expressions. Each kind has the threshold that reached PRECISION on rows
kept back. A proposal is dropped where it meets a base span, or a proposal of higher score (then earlier start).

The trees are fitted on generated sentences (no corpus rows), the thresholds on sentences of other templates in four
languages; features come from the same expressions, and only that small table of numbers reaches the driver.

Places: `split` gives what lies between the matches of a pattern and `regexp_extract_all` the matches. Arrays have no
running sum, and a fold that appends copies what it has, so everything that grows with the matches of a text goes in
blocks: sums over blocks first, then inside each; overlaps are looked for among blocks that touch, and pieces of text
are cut from a block's stretch. So a text's cost stays near its length, however many numbers it holds.
"""

from __future__ import annotations

import json
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

PRECISION = 0.95
TREES, DEPTH, RATE = 24, 3, 0.3
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")

# The base patterns. Possessive repeats keep the matcher's stack flat, and a start is tried only where a
# run of the first class begins or the previous match ended, so long runs cost linear time.
_NAME, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_NAME})){_NAME}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for the pattern to be tried.
NEEDS = {"email": "contains(text, '@')", "ip": "digits", "card": "digits", "phone": "contains(text, '+')"}
_HEX = "[0-9A-Fa-f]{1,4}"
#: Addresses with `::` for one or more groups of zeros: every way to share at most seven groups between its sides.
_SHORT_IP = "|".join([f"::{_HEX}(?::{_HEX}){{0,6}}", *(f"(?:{_HEX}:){{{k}}}(?::{_HEX}){{1,{7 - k}}}" for k in range(1, 7)), f"(?:{_HEX}:){{1,7}}:"])
GENERATORS = (
    ("phone", r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,4}\)?(?:[ .-]{1,2}[0-9]{2,4}){1,4}+(?![0-9A-Za-z-])", "digits"),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9A-Za-z-])", "digits"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "digits"),
    ("secret", r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}+", "digits"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]++)++", "contains(text, 'at)') or contains(text, 'at]') or contains(text, 'at )') or contains(text, 'at ]')"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", "contains(text, ':')"),
    ("ip", rf"(?<![0-9A-Za-z_:])(?:{_SHORT_IP})(?![0-9A-Za-z_:])", "contains(text, '::')"),
)
FEATURES = {
    "kind": "x.kind",
    "length": "length(x.body)",
    "digits": "length(regexp_replace(x.body, '[^0-9]', ''))",
    "letters": "length(regexp_replace(x.body, '[^A-Za-z]', ''))",
    "groups": "regexp_count(x.body, '[0-9]+')",
    "first_group": "length(regexp_extract(x.body, '[0-9]+', 0))",
    "last_group": "length(regexp_extract(x.body, '([0-9]+)[^0-9]*$', 1))",
    "turns": "regexp_count(x.body, '[0-9][A-Za-z]|[A-Za-z][0-9]')",
    "hex_only": "cast(x.body rlike '^[0-9a-f]+$' as int)",
    "capitals": "length(regexp_replace(x.body, '[^A-Z]', ''))",
    "opens": "cast(substring(x.body, 1, 1) = '(' as int)",
    "says_call": "cast(x.before rlike '(?iu)phone|t[eé]l|call|mobile|fax|dial|cell|whatsapp|sms|handy|ruf|m[oó]vil|llam|appel|portable|anruf' as int)",
    "says_ssn": "cast(x.before rlike '(?iu)ssn|social|insurance|sozial|versicherung|s[eé]cu' as int)",
    "says_bank": "cast(x.before rlike '(?iu)iban|account|bank|transfer|konto|cuenta|compte|virement|berweis' as int)",
    "says_secret": "cast(x.before rlike '(?iu)token|secret|passw|api.?key|key|auth|bearer|credential|contrase|clave|schl|geheim|jeton|mot de passe|cl[eé]' as int)",
    "says_other": "cast(x.before rlike '(?iu)version|page|order|item|isbn|date|year|chapter|section|commit|sha|digest|checksum|ratio|score|from|seite|kapitel|p[aá]gina|cap[ií]tulo|chapitre|artikel|art[ií]culo|bestell|pedido|commande|jahr|a[nñ]o|ann[eé]e|prüfsumme|somme|suma|\\\\bid\\\\b' as int)",
    "assigned": "cast(x.before rlike '[=:] ?[\"\\']?$' as int)",
    "quoted": "cast(substring(x.after, 1, 1) in ('\"', '\\'') as int)",
}


def _q(pattern: str) -> str:
    """A pattern as a SQL string."""
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _let(name: str, value: str, body: str) -> str:
    """body with name standing for value, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _blocks(array: str, n: str) -> str:
    """The array in runs of n; array is a name."""
    return f"case when size({array}) = 0 then array() else transform(sequence(1, size({array}), {n}), i -> slice({array}, i, {n})) end"


def _span(kind: int, start: str) -> str:
    return f"named_struct('start', {start}, 'end', {start} + length(x.body), 'kind', {kind}, 'body', x.body)"


_SPANS = "array<struct<start:int,end:int,kind:int,body:string>>"
_NONE = f"cast(array() as {_SPANS})"


def _found(kind: int, pattern: str, when: str) -> str:
    """array<struct<start, end, kind, body>> of the pattern's matches."""
    p = _q(pattern)
    parts = f"filter(zip_with(split(text, {p}, -1), regexp_extract_all(text, {p}, 0), (g, m) -> named_struct('gap', length(g), 'body', m)), x -> x.body is not null)"
    starts = "slice(aggregate(bs, array(0), (a, b) -> array_append(a, element_at(a, -1) + aggregate(b, 0, (t, x) -> t + x.gap + length(x.body)))), 1, size(bs))"
    fold = f"""aggregate(b, named_struct('at', s, 'all', {_NONE}),
      (a, x) -> named_struct('at', a.at + x.gap + length(x.body), 'all', array_append(a.all, {_span(kind, "a.at + x.gap")})), a -> a.all)"""
    placed = _let("bs", _blocks("p", "cast(greatest(64, sqrt(size(p))) as int)"), f"flatten(zip_with(bs, {starts}, (b, s) -> {fold}))")
    return f"case when {when} then {_let('p', parts, f'case when size(p) = 0 then {_NONE} else {placed} end')} else {_NONE} end"


def _framed(array: str) -> str:
    """An array of spans, sorted by start, in blocks with the stretch of text that each takes; array is a name."""
    return f"transform({_blocks(array, '64')}, b -> named_struct('low', element_at(b, 1).start, 'high', array_max(transform(b, x -> x.end)), 'b', b))"


def _clear(spans: str, others: str, beats: str = "true") -> str:
    """The spans that no other `o` overlaps for which `beats` holds. Both are names of sorted arrays."""
    touching = "flatten(transform(filter(os, q -> q.low < f.high and f.low < q.high), q -> q.b))"
    left = _let("near", touching, f"filter(f.b, x -> not exists(near, o -> o.start < x.end and x.start < o.end and ({beats})))")
    whole = _let("os", _framed(others), f"flatten(transform({_framed(spans)}, f -> {left}))")
    return f"case when size({spans}) = 0 or size({others}) = 0 then {spans} else {whole} end"


def _chosen(spans: str, better: str) -> str:
    """Of spans that overlap the better ones: in rounds, those that no better one touches, and then only what they leave.
    The best of a round always stays, so rounds end; spans is a name of an array sorted by start."""
    won = _let("w", _clear("cl", "cl", better), f"named_struct('left', {_clear('cl', 'w')}, 'won', concat(a.won, w))")
    step = f"case when size(a.left) = 0 then a else {_let('cl', 'a.left', won)} end"
    return f"case when size({spans}) < 2 then {spans} else aggregate(sequence(1, size({spans})), named_struct('left', {spans}, 'won', filter({spans}, x -> false)), (a, n) -> {step}, a -> a.won) end"


def _luhn(digits: str) -> str:
    value = f"cast(substring(reverse({digits}), i, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + if(i % 2 = 1, {value}, if({value} > 4, 2 * {value} - 9, 2 * {value}))) % 10 = 0"


_DIGITS = "regexp_replace(x.body, '[^0-9]', '')"
CHECKS = {
    "email": "true",
    "ip": "forall(split(x.body, '[.]'), p -> coalesce(try_cast(p as int) <= 255, false))",
    "card": f"case when length({_DIGITS}) between 13 and 19 then {_luhn(_DIGITS)} else false end",
    "phone": f"length({_DIGITS}) between 9 and 15",
}


def with_base(docs: DataFrame) -> DataFrame:
    """docs with `base`: the checked spans of the four base kinds by kind, then start. A null text has none."""
    out = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("digits", F.expr("text rlike '[0-9]'"))
    found = [f"filter({_found(KINDS.index(k), p, NEEDS[k])}, x -> {CHECKS[k]})" for k, p in BASE.items()]
    return out.withColumn("base", F.expr(f"case when digits or contains(text, '@') then concat({', '.join(found)}) else {_NONE} end"))


def with_proposals(docs: DataFrame) -> DataFrame:
    """Adds `proposals`, by start: what the generators offer and no base span touches, each with its features."""
    found = [_found(KINDS.index(k), p, when) for k, p, when in GENERATORS]
    values = ", ".join(f"'{name}', cast({e} as int)" for name, e in FEATURES.items())
    # Looked up in a block's stretch of the text: a cut from a text costs its place in it.
    seen = "named_struct('start', x.start, 'end', x.end, 'kind', x.kind, 'body', x.body, 'before', substring(t, greatest(x.start - 24 - o, 0) + 1, x.start - o - greatest(x.start - 24 - o, 0)), 'after', substring(t, x.end - o + 1, 2))"
    stretch = "substring(text, greatest(f.low - 24, 0) + 1, f.high + 2 - greatest(f.low - 24, 0))"
    with_text = f"flatten(transform({_framed('proposals')}, f -> {_let('o', 'greatest(f.low - 24, 0)', _let('t', stretch, f'transform(f.b, x -> {seen})'))}))"
    return (
        docs.withColumn("proposals", F.expr(f"array_sort(concat({', '.join(found)}))"))
        .withColumn("sorted_base", F.expr("case when size(proposals) = 0 then base else array_sort(base) end"))
        .withColumn("proposals", F.expr(_clear("proposals", "sorted_base")))
        .withColumn("proposals", F.expr(with_text))
        .withColumn("proposals", F.expr(f"transform(proposals, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind, 'f', named_struct({values})))"))
        .drop("sorted_base")
    )


# ---- boosted trees


def sentences(seed: int = 3, n: int = 900) -> list[dict]:
    """Generated texts with one span each, personal or harmless."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    h = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(k - 2)) + d(2)
    name = lambda: rng.choice(["ana", "li.wei", "j.smith", "omar", "eva_k", "tom99"])
    phone = lambda: rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)}-{d(4)}", f"0{d(3)} {d(3)} {d(3)}", f"0{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}"])
    iban = lambda: rng.choice(["DE", "FR", "ES", "GB"]) + d(2) + " " + " ".join(d(4) for _ in range(rng.randint(4, 5)))
    personal = [
        lambda: rng.choice(["call me at ", "Phone: ", "tel ", "mobile ", "Fax: ", "dial ", "my cell is "]) + phone(),
        lambda: rng.choice(["SSN ", "SSN: ", "social security ", "his social is "]) + f"{d(3)}-{d(2)}-{d(4)}",
        lambda: rng.choice(["IBAN ", "account ", "bank transfer to ", ""]) + iban(),
        lambda: rng.choice(['token = "', "secret: ", 'api_key="', "password=", "auth token ", "bearer ", 'key = "']) + rng.choice([h(32), h(40), mixed(24), mixed(40), "ghp_" + mixed(30), "sk_live_" + mixed(24)]),
        lambda: rng.choice(["write to ", "mail ", ""]) + name() + rng.choice([" [at] ", " (at) ", "[at]"]) + "example" + rng.choice([" [dot] ", " (dot) ", "."]) + "org",
        lambda: "host " + ":".join(h(4) for _ in range(8)),
    ]
    harmless = [
        lambda: rng.choice(["pages ", "chapter ", "section ", "items "]) + f"{d(2)}-{d(rng.randint(2, 3))}",
        lambda: rng.choice(["on ", "date ", "since "]) + f"20{d(2)}-{d(2)}-{d(2)}",
        lambda: rng.choice(["version ", "ratio ", "score "]) + f"{d(2)}.{d(2)}",
        lambda: rng.choice(["ISBN ", "order ", "item "]) + f"{d(3)}-{d(2)}-{d(4)}",
        lambda: rng.choice(["", "sum "]) + f"{d(3)} {d(3)} {d(3)}",
        lambda: rng.choice(["commit ", "sha ", "digest ", "checksum "]) + rng.choice([h(40), h(64)]),
        lambda: rng.choice(["", "the ", "and "]) + "".join(rng.choice(["ness", "tion", "ing", "er"]) for _ in range(7)) + d(1),
        lambda: rng.choice(["between ", "years ", "from "]) + f"19{d(2)}-20{d(2)}",
        lambda: rng.choice(["model ", "part ", "id "]) + f"{d(4)} {d(4)}",
    ]
    out = []
    for i in range(n):
        label = i % 2
        body = rng.choice(personal if label else harmless)()
        out.append({"text": f"{rng.choice(['It was said that ', 'Then ', 'Of the and in ', ''])}{body}{rng.choice(['', '.', ' and more', ', he said', chr(34)])}", "label": label})
    groups = lambda least, most: ":".join(h(rng.randint(1, 4)) for _ in range(rng.randint(least, most)))
    long_personal = [
        lambda: rng.choice(['token = "', "secret: ", 'api_key="', "password=", "auth token ", "bearer ", 'key = "']) + mixed(rng.randint(129, 900)),
        lambda: rng.choice(["host ", "address ", "client ", "logged in from ", "server ", "ping ", ""]) + rng.choice([f"2001:db8::{groups(1, 5)}", f"fe80::{groups(1, 4)}", "fe80::" + d(1), "2001:db8::" + d(1), f"2{d(3)}:{groups(1, 4)}::{d(1)}", f"fd{h(2)}:{d(2)}{h(2)}::", f"2a{d(2)}:{h(4)}:{h(3)}::{groups(1, 3)}"]),
        lambda: rng.choice(["write to ", "mail ", ""]) + "".join(rng.choice(["ana", "li.wei", "j.smith", "omar", "tom99", "_"]) for _ in range(rng.randint(16, 30))) + rng.choice([" [at] ", " (at) ", "[at]"]) + "mail.example" + rng.choice([" [dot] ", " (dot) ", "."]) + "org",
    ]
    long_harmless = [
        lambda: rng.choice(["commit ", "sha ", "digest ", "checksum "]) + h(rng.choice([128, 256])),
        lambda: rng.choice(["", "the ", "and "]) + "".join(rng.choice(["ness", "tion", "ing", "er"]) for _ in range(rng.randint(45, 200))) + d(1),
        lambda: rng.choice(["call ", "use ", "class ", "see ", ""]) + rng.choice(["add", "Abc", "cafe", "a", "fade", "dead", "Bad"]) + "::" + rng.choice(["", "dec", "b", "face", "Add", "fab", "bed"]),
    ]
    for i in range(n // 3):
        label = i % 2
        body = rng.choice(long_personal if label else long_harmless)()
        out.append({"text": f"{rng.choice(['It was said that ', 'Then ', 'Of the and in ', ''])}{body}{rng.choice(['', '.', ' and more', ', he said', chr(34)])}", "label": label})
    return out


def calibration(seed: int = 17, n: int = 1200) -> list[dict]:
    """Texts of other templates than `sentences`, in four languages and in logs and forms, one span each."""
    rng = random.Random(seed)
    pick = rng.choice
    d = lambda k: "".join(pick("0123456789") for _ in range(k))
    h = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(pick("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789_") for _ in range(k - 3)) + "A" + d(2)
    word = lambda: "".join(pick("bdfglmnprst") + pick("aeiou") for _ in range(rng.randint(1, 4)))
    phone = lambda: pick([f"{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"0{d(2)} {d(3)} {d(2)} {d(2)}", f"0{d(3)} {d(4)} {d(3)}", f"{d(3)}.{d(3)}.{d(4)}"])
    personal = [
        lambda: pick(["Reach us by phone: ", "Sie erreichen uns per Telefon ", "Llámenos al teléfono ", "Appelez le ", "Rufen Sie an: ", "Mon portable: ", "Mi móvil es ", "Handy ", "TEL. ", "fax no. "]) + phone(),
        lambda: pick(["ssn=", "Social Security No. ", "numéro de sécu ", "seguro social ", "Sozialversicherung: "]) + f"{d(3)}-{d(2)}-{d(4)}",
        lambda: pick(["Konto: ", "sur le compte ", "a la cuenta ", "virement vers ", "pay into account ", "IBAN: "]) + pick(["DE", "ES", "IT", "AT", "NL"]) + d(2) + " " + " ".join(d(4) for _ in range(rng.randint(4, 5))),
        lambda: pick(["export API_TOKEN=", "Passwort: ", "la contraseña es ", "mot de passe: ", "clave secreta: ", "client_secret: '", "Authorization: Bearer ", "der Schlüssel lautet "]) + pick([mixed(28), mixed(48), "ghp_" + mixed(33), "AKIA" + mixed(24), h(32), h(40)]),
        lambda: pick(["Contact: ", "schreiben Sie an ", "escriba a ", "écrivez à ", "mailto "]) + word() + pick([".", "_", ""]) + word() + pick([" [at] ", " (at) ", "(at)"]) + word() + pick([" [dot] ", " (dot) ", "."]) + pick(["com", "net", "de", "es"]),
        lambda: pick(["Adresse ", "from host ", "dirección ", "peer ", "listen on "]) + pick([":".join(h(4) for _ in range(8)), f"2001:db8:{h(2)}::{h(3)}", f"fe80::{h(4)}:{h(4)}"]),
    ]
    harmless = [
        lambda: pick(["Seite ", "página ", "voir page ", "Kapitel ", "see chapter ", "artículo "]) + f"{d(2)}-{d(2)}",
        lambda: pick(["am ", "el ", "le ", "dated ", "vom ", "fecha "]) + pick([f"19{d(2)}-0{d(1)}-1{d(1)}", f"1{d(1)}.0{d(1)}.20{d(2)}"]),
        lambda: pick(["Bestellung ", "pedido ", "commande ", "order no ", "Artikel "]) + f"{d(3)}-{d(2)}-{d(4)}",
        lambda: pick(["Prüfsumme ", "suma ", "somme de contrôle ", "git commit ", "sha1: ", "digest = "]) + pick([h(40), h(64)]),
        lambda: pick(["zwischen ", "entre ", "from ", "années ", "Jahre "]) + f"18{d(2)}-19{d(2)}",
        lambda: pick(["insgesamt ", "en total ", "about ", "environ "]) + f"{d(2)} {d(3)} {d(3)}",
        lambda: pick(["class ", "el ", "le mot ", "das Wort "]) + "".join(word() for _ in range(6)) + "x" * 8 + d(1),
        lambda: pick(["namespace ", "voir ", "siehe "]) + pick(["Face", "abc", "dab"]) + "::" + pick(["Cafe", "add", ""]),
    ]
    return [{"text": f"{pick(['', 'Hola, ', 'Guten Tag. ', 'Bonjour, ', 'INFO '])}{pick(personal if i % 2 else harmless)()}{pick(['', '.', ';', ' merci', ' danke', chr(39)])}", "label": i % 2} for i in range(n)]


class Trees:
    """Gradient boosting for logistic loss on small integer features, by exact greedy splits."""

    def __init__(self, x, y, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        import numpy as np

        self.np, self.rate = np, rate
        x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
        p = min(max(y.mean(), 0.01), 0.99) if len(y) else 0.5
        self.start, self.trees = float(np.log(p / (1 - p))), []
        margin = np.full(len(y), self.start)
        for _ in range(trees if len(y) else 0):
            q = 1 / (1 + np.exp(-margin))
            tree = self._grow(x, y - q, q * (1 - q), np.arange(len(y)), depth)
            self.trees.append(tree)
            margin += np.array([self.leaf(tree, row) for row in x])

    def _grow(self, x, g, h, rows, depth):
        np = self.np
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if depth:
            for f in range(x.shape[1]):
                values = x[rows, f]
                for cut in np.unique(values)[:-1]:
                    left = rows[values <= cut]
                    lg, lh = g[left].sum(), h[left].sum()
                    rg, rh = total_g - lg, total_h - lh
                    if min(lh, rh) < 0.5:
                        continue
                    gain = lg**2 / (lh + 1) + rg**2 / (rh + 1) - total_g**2 / (total_h + 1)
                    if gain > best[0] + 1e-9:
                        best = (gain, f, float(cut))
        if best[1] is None:
            return round(float(self.rate * total_g / (total_h + 1)), 6)
        below = x[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(x, g, h, rows[below], depth - 1), self._grow(x, g, h, rows[~below], depth - 1)

    def leaf(self, tree, row) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def margin(self, row) -> float:
        return self.start + sum(self.leaf(t, row) for t in self.trees)

    def sql(self) -> str:
        names = list(FEATURES)

        def write(t) -> str:
            return f"(case when x.f.{names[t[0]]} <= {t[1]:g} then {write(t[2])} else {write(t[3])} end)" if isinstance(t, tuple) else f"{t:.6f}D"

        return " + ".join([f"{self.start:.6f}D", *map(write, self.trees)])


_FITTED: dict[tuple, tuple] = {}


def _featured(spark, rows: list[dict]) -> list[tuple[tuple, int]]:
    """Features and label of each proposal in generated texts; the personal one's other finds count as personal."""
    texts = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<text:string,label:int>>")).alias("s")).select("s.text", "s.label")
    # An inner explode would have its filter on `proposals` pushed down, and the expression written out at every mention.
    found = with_proposals(with_base(texts)).select("label", F.explode_outer("proposals").alias("x")).where("x is not null").select("label", "x.f.*").collect()
    return [(tuple(r[n] or 0 for n in FEATURES), r.label) for r in found]


def fit(spark, seed: int = 3, precision: float = PRECISION) -> tuple[Trees, dict[int, float]]:
    """Trees, and for each kind the lowest margin from which on the calibration texts reach the precision; at least 0.
    The same for every session, so it is kept in the driver."""
    if (seed, precision) in _FITTED:
        return _FITTED[seed, precision]
    train, back = _featured(spark, sentences(seed)), _featured(spark, calibration(seed + 14))
    trees = Trees([x for x, _ in train], [y for _, y in train])
    thresholds = {}
    for kind in range(len(KINDS)):
        scored = sorted(((trees.margin(x), y) for x, y in back if x[0] == kind), reverse=True)
        hits, best = 0, None
        for i, (m, y) in enumerate(scored, 1):
            hits += y
            if hits / i >= precision and (i == len(scored) or scored[i][0] < m):
                best = (m + scored[i][0]) / 2 if i < len(scored) else min(m, 0.0)
        thresholds[kind] = max(best, 0.0) if best is not None else 1e9
    _FITTED[seed, precision] = trees, thresholds
    release(spark)
    return trees, thresholds


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with `base` and `spans`: array<struct<kind, start, end>> by kind, then start; text is never null."""
    trees, thresholds = fit(docs.sparkSession)
    limits = "array(" + ", ".join(f"{thresholds[k]:.6f}D" for k in range(len(KINDS))) + ")"
    better = "o.m > x.m or (o.m = x.m and (o.start < x.start or (o.start = x.start and (o.end > x.end or (o.end = x.end and o.kind < x.kind)))))"
    plain = "named_struct('kind', x.kind, 'start', x.start, 'end', x.end)"
    return (
        with_proposals(with_base(docs))
        .withColumn("scored", F.expr(f"filter(transform(proposals, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind, 'm', {trees.sql()})), x -> x.m >= element_at({limits}, x.kind + 1))"))
        .withColumn("scored", F.expr(_chosen("scored", better)))
        .withColumn("spans", F.expr(f"array_sort(concat(transform(base, x -> {plain}), transform(scored, x -> {plain})))"))
        .drop("proposals", "scored", "digits")
    )


_NAMES = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(element_at({_NAMES}, x.kind + 1), ':', x.start, ':', x.end)), ',')"


def report(docs: DataFrame) -> DataFrame:
    """A row a document: counts of the base kinds, digest of the base spans, all spans.

    Null and empty texts have none; repeated rows are read as they come; an empty table gives none; other columns are
    left aside, so their names don't matter; very long texts are read whole, their matches in blocks.
    """
    found = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {KINDS.index(k)})) as long)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(F.expr(_joined("base")), 256).alias("base_sha256"), F.expr(_joined("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The columns of docs with every span of `text` replaced by its kind in brackets; a null text stays null.

    Of spans that overlap, the first by start is replaced. Repeated rows, long texts and an empty table: as in report.
    """
    columns = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("text"))
    kinds = f"upper(element_at({_NAMES}, x.kind + 1))"
    # Where each block's stretch of the text begins: the furthest end before it. Inside, places count from there.
    begins = "slice(aggregate(bs, array(0), (a, b) -> array_append(a, greatest(element_at(a, -1), array_max(transform(b, x -> x.end))))), 1, size(bs))"
    fold = f"""aggregate(b, named_struct('at', 0, 'out', ''),
      (a, x) -> named_struct('at', greatest(a.at, x.end - s), 'out', if(x.start - s >= a.at, concat(a.out, substring(t, a.at + 1, x.start - s - a.at), '[', {kinds}, ']'), a.out)), a -> a.out)"""
    stretch = "substring(text, s + 1, greatest(array_max(transform(b, x -> x.end)) - s, 0))"
    pieces = f"array_join(zip_with(bs, {begins}, (b, s) -> {_let('t', stretch, fold)}), '')"
    rest = "substring(text, array_max(transform(spans, x -> x.end)) + 1)"
    ordered = "array_sort(transform(spans, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind)))"
    text = F.expr(f"case when size(spans) = 0 then text else concat({_let('p', ordered, _let('bs', _blocks('p', '256'), pieces))}, {rest}) end")
    done = with_spans(inner).withColumn("text", F.when(F.col("row").getField("text").isNotNull(), text))
    return done.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns])


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of every whole text of the documents; see report for awkward rows."""
    from .common import table

    return report(table(spark, sf_dir, "documents"))
