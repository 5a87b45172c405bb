"""Variant spellings of names: a symmetric-delete index on tokens, then alignment of tokens by optimal assignment.

Names become forms (folded tokens without titles, legal endings and quoted nicknames). Forms that share an index key are
compared: their tokens are assigned to each other at the least cost, where a token may match by small edits, as an
initial, an abbreviation or a nickname. Links by edits alone join forms into classes. Weak classes (initials, acronyms,
abbreviations, nicknames, single words) join a class only if it is the one class they fit, or the one that aliases name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations, permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.near_duplicates import near_duplicate_classes
from lectern.llm.textutil import fold
from lectern.session import cut

# Titles, legal endings, function words, and nicknames of given names.
TITLES = {"dr", "prof", "professor", "doctor", "mr", "mrs", "ms", "miss", "sir", "dame", "herr", "frau", "mme", "m", "sr", "sra"}
LEGAL = {"gmbh", "ag", "inc", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "plc", "sa", "se", "kg", "ges", "mbh", "incorporated", "gesellschaft", "aktiengesellschaft", "bv", "srl"}
SMALL = {"the", "of", "for", "and", "de", "der", "die", "das", "du", "des", "la", "le", "el", "und", "et", "y"}
NICKNAMES = {
    "albert": "al bert bertie", "alexander": "alex sasha sandy", "alice": "ali allie", "andrew": "andy drew", "anthony": "tony", "anton": "tony toni",
    "barbara": "barb babs", "benjamin": "ben benny benji", "bettina": "betty tina", "boris": "borya", "bruno": "bru", "catherine": "cathy cat kate katie", "cedric": "ced",
    "charles": "charlie chuck chas", "christopher": "chris kit topher", "clara": "claire", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie debby",
    "dmitri": "dima mitya", "dora": "dory", "dorothy": "dot dottie dolly", "edward": "ed eddie ted teddy ned", "eleanor": "ellie nell nora", "elena": "lena", "elizabeth": "liz lizzie beth betsy betty eliza",
    "felix": "fee", "frederick": "fred freddie freddy", "gregory": "greg", "gustav": "gus", "helga": "helge", "henrik": "hen rik", "henry": "harry hank", "igor": "gosha",
    "isabelle": "izzy bella belle", "james": "jim jimmy jamie", "jessica": "jess jessie", "joanna": "jo joey", "john": "jack johnny", "jonas": "jon", "joseph": "joe joey jo",
    "joshua": "josh", "karin": "kari", "katherine": "kate kathy katie kat kitty", "kenneth": "ken kenny", "lawrence": "larry", "leonard": "leo len lenny", "lucia": "lucy",
    "margaret": "maggie meg peggy marge greta", "matteo": "teo", "matthew": "matt matty", "michael": "mike mick mickey", "mireille": "mimi", "nadia": "nadya", "natalia": "natasha",
    "nicholas": "nick nicky nico", "olga": "olya", "oskar": "ossie", "patricia": "pat patty tricia", "patrick": "pat paddy rick", "paula": "paulie", "pedro": "pete",
    "peter": "pete", "quentin": "quen", "rebecca": "becky becca", "richard": "rich rick ricky dick", "robert": "bob bobby rob robbie bert", "ronald": "ron ronnie",
    "samuel": "sam sammy", "stephen": "steve", "susan": "sue susie suzy", "tanja": "tanya", "theodore": "ted teddy theo", "theresa": "terry tess", "thomas": "tom tommy",
    "ulrich": "uli", "vera": "vee", "victor": "vic", "victoria": "vicky tori", "walter": "walt wally", "wanda": "wendy", "william": "will bill billy willy liam", "zoltan": "zoli",
}
FORMAL: dict[str, set[str]] = {}
for _full, _shorts in NICKNAMES.items():
    for _short in _shorts.split():
        FORMAL.setdefault(_short, set()).add(_full)
#: Kinds of entity by the words used as type.
KINDS = {"person": {"person", "people", "speaker"}, "organization": {"organization", "organisation", "company", "org", "agency"}, "software": {"software", "app", "product", "system", "tool"}}

WORDS = re.compile(r"[^\W_]+")

#: One slip of a token is expected in less than one of so many of its forms.
SLIPS = 20


# Rows of a keyboard with their offsets, and letters written for each other by sound.
KEYS = (("qwertyuiop", 0.0), ("asdfghjkl", 0.25), ("zxcvbnm", 0.75))
SOUNDS = ("iy", "ck", "vw", "sz", "fv", "cs", "ck", "qk", "gj", "ij", "bp", "dt")
_AT = {c: (row, i + off) for row, (keys, off) in enumerate(KEYS) for i, c in enumerate(keys)}
CLOSE = {(a, b) for a, (r, x) in _AT.items() for b, (q, y) in _AT.items() if a != b and abs(r - q) <= 1 and abs(x - y) <= 1.01} | {p for a, b in SOUNDS for p in ((a, b), (b, a))}


def osa(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between two words; most + 1 if more.

    Replacing a letter by one that is neither near on a keyboard nor like in sound counts as two: such a slip is rare, and
    different names often differ so.
    """
    if a == b:
        return 0
    n, m, far = len(a), len(b), most + 1
    if abs(n - m) > most:
        return far
    # only cells within ``most`` of the diagonal can count, so long words stay linear
    before: dict[int, int] = {}
    row = {j: j for j in range(min(m, most) + 1)}
    for i in range(1, n + 1):
        x, new = a[i - 1], {}
        for j in range(max(0, i - most), min(m, i + most) + 1):
            if j == 0:
                new[0] = i
                continue
            y = b[j - 1]
            swap = 0 if x == y else 1 if (x, y) in CLOSE else 2
            d = min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + swap)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before.get(j - 2, far) + 1)
            new[j] = d
        if min(new.values()) > most:
            return far
        before, row = row, new
    return min(row.get(m, far), far)


#: Longest word with a whole deletion neighbourhood.
LONG = 40


def deletes(word: str, most: int) -> set[str]:
    """The symmetric-delete neighbourhood: the word with up to ``most`` characters left out.

    Words over ``LONG`` characters have too many of those. Two edits leave their beginning, their middle or their end whole: these
    stand for them, the middle at each place to which two edits before it can move it.
    """
    if len(word) > LONG:
        middle = len(word) // 2 - 6
        return {word, "^" + word[:12], word[-12:] + "$"} | {"~" + word[middle + s : middle + s + 12] for s in range(-3, 4)}
    out, layer = {word}, {word}
    for _ in range(most):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        out |= layer
    return out


def parse(name: str, kind: str) -> tuple[list[str], str, bool]:
    """Tokens, concatenation and whether the name is an acronym. Tokens keep the order given name, surname where a comma tells it."""
    text = re.sub(r"\([^)]*\)", " ", name) if re.sub(r"\([^)]*\)", "", name).strip() else name
    dotted = re.fullmatch(r"\s*(?:[A-Za-z]\.){2,7}\s*", text)
    if dotted:
        text = text.replace(".", "")
    elif kind != "person":
        text = re.sub(r"\b(?:[A-Za-z]\.){2,7}(?!\w)", lambda m: m.group(0).replace(".", ""), text)  # A.G.
    bare = text.strip()
    acronym = kind != "person" and bool(re.fullmatch(r"[A-Z]{2,6}", bare)) and len(bare) <= 6
    quoted = re.sub(r"[“\"„‘'«][^”\"“’'»]+[”\"“’'»]", " ", text)
    text = quoted if WORDS.search(quoted) else text
    if "," in text:
        left, _, right = text.partition(",")
        if WORDS.search(right):
            text = f"{right} {left}"
    raw = WORDS.findall(fold(text))
    if kind == "person":
        tokens = [t for t in raw if t not in TITLES or (len(t) == 1 and len(raw) <= 2)] or raw
        long = [t for t in tokens if len(t) > 1]
        tokens = long if len(long) >= 2 else tokens
    else:
        tokens = [t for t in raw if t not in SMALL] or raw
        while len(tokens) > 1 and tokens[-1] in LEGAL:
            tokens.pop()
        while len(tokens) > 1 and tokens[0] in LEGAL and len(tokens[0]) > 1:  # 'Co, Name' after a comma
            tokens.pop(0)
    return tokens, "".join(tokens), acronym


def _ends(word: str) -> set[str]:
    """Beginnings and ends of a word of which one edit leaves at least one as it is."""
    if len(word) <= 4:
        return deletes(word, 1)
    return {e for k in (2, 3) if (k == 2 and len(word) <= 6) or (k == 3 and len(word) >= 6) for e in ("^" + word[:k], word[-k:] + "$")} | (deletes(word, 1) if len(word) == 5 else set())


def index_keys(tokens: list[str], freq: list[int], cat: str, acronym: bool, kind: str, hot: int) -> tuple[set[str], set[str]]:
    """Keys under which a form is looked for; two forms of one name share at least one.

    The second set holds the keys of hot tokens with a mere initial of the other, under which many forms stand: these are
    met only from forms with an initial, an abbreviation or a single word (``seeks``), never by each other.
    """
    keys, wide = {"c:" + cat}, set()
    n = len(tokens)
    if n == 2:
        keys.add("c:" + tokens[1] + tokens[0])
    if n == 1:
        most = 2 if len(cat) >= 9 else 1 if len(cat) >= 5 else 0
        keys |= {"w:" + v for v in deletes(cat, most)}
        if acronym:
            keys.add("i:" + "".join(sorted(cat)))
        elif len(cat) >= 4:
            keys.add("p:" + cat)
        return keys, wide
    if kind == "software":
        keys |= {"w:" + v for v in deletes(cat, 1)}
    if n == 2:
        picked = [i for i in (0, 1) if len(tokens[i]) >= 4 and freq[i] <= hot] or [i for i in (0, 1) if len(tokens[i]) >= 3]
        for i in (0, 1):
            token, other = tokens[i], tokens[1 - i]
            if len(token) < 3:
                continue
            most = 2 if len(token) >= 7 else 1
            gone = deletes(token, most)
            by_initial = {f"s:{v}|{c}" for v in gone for c in {other[0]} | {f[0] for f in FORMAL.get(other, ())}}
            if i in picked and freq[i] <= hot:
                keys |= by_initial
            else:
                wide |= by_initial
            # whatever is hot: edits of this token beside the other one whole (or its full name), and one edit in both
            keys |= {f"d:{v}|{o}" for v in gone for o in {other} | FORMAL.get(other, set())}
            if len(other) >= 3:
                keys |= {f"e:{v}|{e}" for v in deletes(token, 1) for e in _ends(other)}
    else:
        keys.add("i:" + "".join(sorted(t[0] for t in tokens)))
        for i, t in enumerate(tokens):
            others = "".join(sorted(o[0] for j, o in enumerate(tokens) if j != i))
            keys |= {f"y:{v}|{others}" for v in deletes(t, 2 if len(t) >= 7 else 1 if len(t) >= 3 else 0)}
        if n <= 6:
            keys |= {"t:" + "|".join(sorted(t[:4] for t in three)) for three in combinations(tokens, 3)}
    if kind != "person":
        for t, f in zip(tokens, freq):
            if len(t) >= 5:
                (keys if f <= hot else wide).add("p:" + t)
    return keys, wide - keys


def seeks(tokens: list[str], kind: str) -> bool:
    """Whether a form may be short for others: an initial, an abbreviation or a single word."""
    if kind == "person":
        return len(tokens) == 2 and min(map(len, tokens)) == 1
    return len(tokens) == 1 or (len(tokens) == 2 and min(map(len, tokens)) <= 5)


def _token_cost(a: str, b: str, fa: int, fb: int, kind: str, settled: int) -> tuple[float, int, bool] | None:
    """Cost, edits and weakness of matching two tokens; None if they do not."""
    if a == b:
        return 0.0, 0, False
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if len(short) == 1:
        return (1.0, 0, True) if kind == "person" and (long[0] == short or any(f[0] == short for f in FORMAL.get(long, ()))) else None
    if kind == "person" and (a in FORMAL.get(b, ()) or b in FORMAL.get(a, ()) or FORMAL.get(a, set()) & FORMAL.get(b, set())):
        return 0.5, 0, True
    # two settled tokens are two names, however close; what counts as settled grows with the other token, as its slips do
    if min(fa, fb) < settled + max(fa, fb) / SLIPS:
        most = 2 if len(short) >= 7 else 1 if len(short) >= 3 else 0
        d = osa(a, b, most)
        if d <= most:
            return float(d), d, False
    if kind != "person" and short[0] == long[0] and 2 <= len(short) <= 5 and len(long) > len(short) and (long.startswith(short) or _subsequence(short, long)):
        return 1.0, 0, True
    return None


def _subsequence(short: str, long: str) -> bool:
    at = iter(long)
    return all(c in at for c in short)


def _assign(costs: list[list[float | None]]) -> list[int] | None:
    """Columns of the rows at the least total cost; None if some row cannot have any. Few tokens by trial, more by augmenting paths."""
    n = len(costs)
    if n <= 6:
        fits = [p for p in permutations(range(n)) if all(costs[i][j] is not None for i, j in enumerate(p))]
        return list(min(fits, key=lambda p: sum(costs[i][j] for i, j in enumerate(p)))) if fits else None
    if not all(any(c is not None for c in row) for row in costs):
        return None
    far = 1e6
    u, v, owner = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        owner[0], at, low, way, used = i, 0, [math.inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while owner[at]:
            used[at], row, step, to = True, owner[at], math.inf, 0
            for j in range(1, n + 1):
                if not used[j]:
                    c = costs[row - 1][j - 1]
                    d = (far if c is None else c) - u[row] - v[j]
                    if d < low[j]:
                        low[j], way[j] = d, at
                    if low[j] < step:
                        step, to = low[j], j
            for j in range(n + 1):
                if used[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    low[j] -= step
            at = to
        while at:
            owner[at], at = owner[way[at]], way[at]
    chosen = [0] * n
    for j in range(1, n + 1):
        chosen[owner[j] - 1] = j - 1
    return None if any(costs[i][j] is None for i, j in enumerate(chosen)) else chosen


def align(ta: list[str], tb: list[str], fa: list[int], fb: list[int], aa: bool, ab: bool, kind: str, settled: int = 3) -> tuple[bool, bool]:
    """Whether two forms can denote the same, and whether that link is weak."""
    ca, cb = "".join(ta), "".join(tb)
    if ca == cb or (len(ta) == 2 and ta[1] + ta[0] == cb) or (len(tb) == 2 and tb[1] + tb[0] == ca):
        return True, False
    if len(ta) > len(tb):
        ta, tb, fa, fb, aa, ab, ca, cb = tb, ta, fb, fa, ab, aa, cb, ca
    if len(ta) == 1 and len(tb) > 1:
        if aa and len(tb) >= 3 and sorted(ca) == sorted(t[0] for t in tb):
            return True, True
        if kind == "person":
            return False, False
        if len(ca) >= 4 and ca in tb and kind != "software":
            return True, True
        return (kind == "software" and osa(ca, cb, 1) <= 1, False)
    if len(ta) != len(tb):
        return False, False
    if len(ta) == 1:
        if aa or ab or min(len(ca), len(cb)) < 5:
            return False, False
        most = 2 if min(len(ca), len(cb)) >= 9 else 1
        if kind == "software" and ca[-2:] != cb[-2:] and osa(ca[:-2], cb[:-2], 0) == 0:
            return False, False
        return osa(ca, cb, most) <= most, False
    costs = [[_token_cost(x, y, p, q, kind, settled) for y, q in zip(tb, fb)] for x, p in zip(ta, fa)]
    chosen = _assign([[None if c is None else c[0] for c in row] for row in costs])
    if chosen is None:
        return False, False
    edits, weak = sum(costs[i][j][1] for i, j in enumerate(chosen)), [costs[i][j][2] for i, j in enumerate(chosen)]
    longest = max(len(t) for t in ta)
    if edits > 2 or all(weak) or (longest < 4):
        return False, False
    return True, any(weak)


def _kind_of(types: DataFrame) -> DataFrame:
    tidy = F.lower(F.trim(F.col("type")))
    named = F.lit(None).cast("string")
    for kind, values in KINDS.items():
        named = F.when(tidy.isin(*sorted(values)), F.lit(kind)).otherwise(named)
    return F.when(F.col("type").isNull(), F.lit("unknown")).otherwise(F.coalesce(named, F.lit("other")))


def _met(indexed: DataFrame) -> DataFrame:
    """Pairs of forms (a, b), a < b, that share a key of the index (form, key, wide, seeks).

    The index holds about a hundred keys a form, which no estimate of its size tells: without the hints a table of few megabytes
    would have it sent through the driver.
    """
    keyed = indexed.where("not wide").select("form", "key").hint("merge")
    met = keyed.withColumnRenamed("form", "a").join(keyed.withColumnRenamed("form", "b"), "key").where("a < b").select("a", "b")
    # keys that stand for many forms: only from a short form to the others, or between a short form's own and the narrow ones
    seeking = indexed.where("seeks").select(F.col("form").alias("a"), "key", F.col("wide").alias("wa")).hint("merge")
    sought = indexed.select(F.col("form").alias("b"), "key", F.col("wide").alias("wb")).hint("merge")
    asked = seeking.join(sought, "key").where("a <> b and (wa or wb)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return met.unionByName(asked).distinct()


def name_classes(
    entities: DataFrame, *, name_col: str = "name", type_col: str = "type", alias_col: str = "aliases", hot: int = 40
) -> DataFrame:
    """Names with the class of their entity: (name, kind, class_id), one row per distinct name.

    kind is person, organization, software or other (places, unknown types); classes span names of one kind. Null and
    blank names have no row; null, empty and foreign aliases are no evidence. Rows delivered twice change nothing.
    An empty table gives no rows. ``hot``: tokens in more forms than this are indexed beside the other token only, and by
    initials of the other only for forms that have no more than these.
    """
    rows = entities.select(F.col(name_col).alias("name"), F.col(type_col).alias("type"), F.col(alias_col).alias("aliases")).where(F.trim("name") != "")
    tally = rows.select("name", _kind_of(rows).alias("kind")).groupBy("name").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in (*KINDS, "other")]
    )
    top = F.greatest(*[F.col(k) for k in (*KINDS, "other")])
    kind = F.lit("other")
    for k in ("other", "software", "organization", "person"):
        kind = F.when((F.col(k) == top) & (top > 0), F.lit(k)).otherwise(kind)
    kind = F.when(top == 0, F.lit("unknown")).otherwise(kind)
    named = tally.select("name", kind.alias("kind"))

    def forms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for name, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                guess = kind
                if kind == "unknown":
                    words = name.replace(",", " ").split()
                    legal = words and words[-1].strip(".").lower() in LEGAL
                    guess = "organization" if legal or len(words) > 2 and " of " in name or len(words) >= 4 or re.fullmatch(r"[A-Z]{3,6}", name.strip()) else "person"
                    if len(words) == 1 and not name.startswith("@") and guess == "person":
                        guess = "software"
                tokens, cat, acronym = parse(name, guess)
                if not cat:
                    tokens, cat = [fold(name).strip()], fold(name).strip()
                for column, value in zip(out, (name, guess, tokens, acronym, ("A:" if acronym else "") + (" ".join(sorted(tokens)) if guess == "person" else " ".join(tokens)))):
                    column.append(value)
            types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["name", "kind", "tokens", "acronym", "canon"])

    parsed = named.mapInArrow(forms_of, "name string, kind string, tokens array<string>, acronym boolean, canon string")
    parsed = cut(parsed.withColumn("form", F.xxhash64("kind", "canon")))
    forms = parsed.groupBy("form").agg(F.first("kind").alias("kind"), F.min(F.struct("tokens", "acronym")).alias("_t")).select("form", "kind", "_t.*")
    freq = forms.select("kind", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("kind", "token").agg(F.count(F.lit(1)).cast("int").alias("n"))
    placed = forms.select("form", "kind", F.posexplode("tokens").alias("at", "token")).join(freq, ["kind", "token"])
    counts = placed.groupBy("form").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("_n")).select("form", F.col("_n.n").alias("freq"))
    forms = cut(forms.join(counts, "form"))

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, kinds, toks, acr, fr = (batch.column(i).to_pylist() for i in range(5))
            out_f, out_k, out_w, out_s = [], [], [], []
            for form, kind, tokens, acronym, freq in zip(f, kinds, toks, acr, fr, strict=True):
                for wide, keys in enumerate(index_keys(tokens, freq, "".join(tokens), acronym, kind, hot)):
                    out_f += [form] * len(keys)
                    out_k += [f"{kind}:{key}" for key in keys]
                    out_w += [bool(wide)] * len(keys)
                    out_s += [seeks(tokens, kind)] * len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((out_f, out_k, out_w, out_s), (pa.int64(), pa.string(), pa.bool_(), pa.bool_()))], ["form", "key", "wide", "seeks"])

    indexed = forms.select("form", "kind", "tokens", "acronym", "freq").mapInArrow(keys_of, "form long, key string, wide boolean, seeks boolean")
    indexed = cut(indexed.select("form", F.xxhash64("key").alias("key"), "wide", "seeks"))
    pairs = _met(indexed)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ta, tb, fa, fb, aa, ab, kinds = (batch.column(i).to_pylist() for i in range(9))
            rows = []
            for x in zip(a, b, ta, tb, fa, fb, aa, ab, kinds, strict=True):
                ok, weak = align(*x[2:9])
                if ok:
                    rows.append((x[0], x[1], weak))
            cols = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "weak"])

    side = lambda s: forms.select(F.col("form").alias(s), F.col("tokens").alias(f"t{s}"), F.col("freq").alias(f"f{s}"), F.col("acronym").alias(f"x{s}"), F.col("kind").alias(f"k{s}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").where("ka = kb").select("a", "b", "ta", "tb", "fa", "fb", "xa", "xb", "ka")
    links = cut(full.mapInArrow(verify, "a long, b long, weak boolean"))
    strong = links.where("not weak").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    classes = cut(near_duplicate_classes(strong, forms, id_col="form").select(F.col("id").alias("form"), F.col("class_id").alias("cls")))

    # how weak a class is, by its fullest form: 2 for initials, acronyms and single words of longer names, 1 for nicknames, else 0
    short = F.when(F.col("kind") == "person", F.exists("tokens", lambda t: F.length(t) == 1)).otherwise((F.col("kind") == "organization") & (F.size("tokens") == 1))
    nickname = (F.col("kind") == "person") & F.exists("tokens", lambda t: t.isin(*sorted(FORMAL)))
    sizes = forms.select("form", F.aggregate("tokens", F.lit(0), lambda s, t: s + F.length(t)).alias("size"), F.when(short, 2).when(nickname, 1).otherwise(0).alias("level"))
    status = classes.join(sizes, "form").groupBy("cls").agg(F.min("level").alias("level"), F.max("size").alias("size"))
    both_ways = lambda x, y: F.explode(F.array(F.struct(F.col(x).alias("cx"), F.col(y).alias("cy")), F.struct(F.col(y).alias("cx"), F.col(x).alias("cy")))).alias("p")
    of = lambda form, cls: classes.select(F.col("form").alias(form), F.col("cls").alias(cls))
    linked = links.where("weak").join(of("a", "ca"), "a").join(of("b", "cb"), "b").where("ca <> cb").select(both_ways("ca", "cb")).select("p.*").distinct()
    by_canon = parsed.select("name", "form", "kind")
    told = rows.select("name", F.explode("aliases").alias("alias")).where(F.trim("alias") != "").distinct()
    told = told.join(by_canon.select("name", F.col("form").alias("fx")), "name").join(by_canon.select(F.col("name").alias("alias"), F.col("form").alias("fy")), "alias")
    told = told.join(of("fx", "ca"), "fx").join(of("fy", "cb"), "fy").where("ca <> cb").select(both_ways("ca", "cb")).select("p.*").distinct()
    about = lambda s: status.select(F.col("cls").alias(f"c{s}"), F.col("level").alias(f"l{s}"), F.col("size").alias(f"s{s}"))
    offers = linked.join(about("x"), "cx").join(about("y"), "cy").join(told.withColumn("told", F.lit(True)), ["cx", "cy"], "left")
    offers = cut(offers.withColumn("told", F.coalesce("told", F.lit(False))))
    # nicknames and abbreviations first, towards the fuller form; then what is shorter still, towards the classes that this makes
    first = _join_classes(classes.select("cls").distinct(), offers.where("lx < 2 and ly < 2 and (lx > ly or (lx = ly and sx < sy))").select("cx", "cy", "told"))
    held = first.select(F.col("cls").alias("cy"), F.col("class_id").alias("held"))
    second = offers.where("lx = 2 and ly < 2").join(held, "cy").groupBy("cx", F.col("held").alias("cy")).agg(F.max("told").alias("told"))
    merged = first.select(F.col("class_id").alias("cls")).distinct()
    last = _join_classes(merged, second).withColumnRenamed("cls", "_first").withColumnRenamed("class_id", "_last")
    final = first.join(last, F.col("class_id") == F.col("_first")).select("cls", F.col("_last").alias("class_id"))
    return parsed.select("name", "kind", "form").join(classes, "form").join(final, "cls").select("name", "kind", "class_id")


def _join_classes(classes: DataFrame, offers: DataFrame) -> DataFrame:
    """Classes (cls, class_id) after each took its only offer (cx to cy), or the only one that aliases tell of."""
    told = F.col("told")
    chosen = offers.groupBy("cx").agg(F.count(F.lit(1)).alias("n"), F.count_if(told).alias("m"), F.min("cy").alias("one"), F.min(F.when(told, F.col("cy"))).alias("named"))
    chosen = chosen.select("cx", F.when(F.col("n") == 1, F.col("one")).when(F.col("m") == 1, F.col("named")).alias("cy")).where("cy is not null")
    grown = near_duplicate_classes(chosen.select(F.col("cx").alias("id_a"), F.col("cy").alias("id_b")), classes.select(F.col("cls").alias("id")), id_col="id")
    return cut(grown.select(F.col("id").alias("cls"), "class_id"))


def spelling_pairs(classes: DataFrame, kinds: tuple[str, ...] = ("person", "organization", "software")) -> DataFrame:
    """All pairs of different names of one class: (name_a, name_b), name_a < name_b in code point order."""
    kept = classes.where(F.col("kind").isin(*kinds))
    a, b = kept.select("class_id", F.col("name").alias("name_a")), kept.select("class_id", F.col("name").alias("name_b"))
    return a.join(b, "class_id").where("name_a < name_b").select("name_a", "name_b").distinct()
