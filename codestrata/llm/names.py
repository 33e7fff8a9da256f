"""Spellings typed by people that mean the same person or organisation."""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import frame_stage, spread, stage

# Short forms of given names, each with the names it may stand for.
SHORT_FORMS = {
    "abby": "abigail", "al": "alan albert alexander", "alex": "alexander alexandra", "sasha": "alexander alexandra", "andy": "andrew andreas", "drew": "andrew", "angie": "angela", "tony": "anthony antonio",
    "art": "arthur", "barb": "barbara", "ben": "benjamin benedict", "benny": "benjamin", "benji": "benjamin", "beth": "elizabeth bethany", "betty": "elizabeth", "betsy": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth", "lisa": "elizabeth",
    "bill": "william", "billy": "william", "will": "william", "willy": "william", "liam": "william", "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert", "bert": "robert albert", "becky": "rebecca", "becca": "rebecca", "reba": "rebecca",
    "cathy": "catherine katherine", "kate": "katherine catherine", "kathy": "katherine", "katie": "katherine", "kat": "katherine", "kay": "katherine", "kitty": "katherine", "charlie": "charles charlotte", "chuck": "charles", "chaz": "charles", "chris": "christopher christian christina christine", "topher": "christopher", "kit": "christopher",
    "cindy": "cynthia", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "debby": "deborah", "dick": "richard", "rick": "richard frederick", "ricky": "richard", "rich": "richard", "richie": "richard",
    "don": "donald", "doug": "douglas", "ed": "edward edwin", "eddie": "edward", "ned": "edward", "ted": "edward theodore", "teddy": "theodore edward", "theo": "theodore", "frank": "francis franklin", "fran": "frances francis francois", "fred": "frederick alfred", "freddie": "frederick", "freddy": "frederick",
    "gabe": "gabriel", "geoff": "geoffrey", "gerry": "gerald", "gosia": "malgorzata", "malgosia": "malgorzata", "greg": "gregory", "gus": "august", "hal": "harold henry", "hank": "henry", "harry": "harold henry", "inga": "ingrid", "inge": "ingrid", "jack": "john", "jake": "jacob", "jim": "james", "jimmy": "james", "jamie": "james",
    "jeff": "jeffrey", "jen": "jennifer", "jenny": "jennifer", "jenn": "jennifer", "jerry": "gerald jeremy", "joe": "joseph", "joey": "joseph", "jon": "jonathan john", "jonny": "jonathan", "johnny": "john jonathan", "josh": "joshua", "judy": "judith", "ken": "kenneth", "kim": "kimberly", "larry": "lawrence", "len": "leonard",
    "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "marge": "margaret", "margie": "margaret", "greta": "margaret", "mandy": "amanda", "matt": "matthew", "mattie": "matthew", "mel": "melissa melanie", "mike": "michael", "mick": "michael", "mickey": "michael", "mitch": "mitchell", "nate": "nathan nathaniel", "nick": "nicholas", "nicky": "nicholas nicole", "nico": "nicholas",
    "pam": "pamela", "pat": "patricia patrick", "patty": "patricia", "tricia": "patricia", "trish": "patricia", "pete": "peter", "phil": "philip phillip", "ray": "raymond", "ron": "ronald", "sam": "samuel samantha", "sammy": "samuel", "sandy": "sandra alexander", "steve": "steven stephen", "stu": "stuart", "sue": "susan", "susie": "susan", "suzy": "susan",
    "tim": "timothy", "tina": "christina valentina martina", "val": "valentina valerie", "tom": "thomas tomas", "tommy": "thomas", "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "vic": "victor victoria", "vince": "vincent", "walt": "walter", "wes": "wesley", "zack": "zachary", "ollie": "oliver oluwaseun", "seun": "oluwaseun", "joss": "joseph", "iva": "ivana", "eng": "engineering", "tech": "technologies technology", "sys": "systems", "res": "research", "soft": "software", "sw": "software", "svc": "services",
    "svcs": "services", "anal": "analytics", "dev": "development", "intl": "international", "mfg": "manufacturing", "assoc": "associates", "univ": "university", "dept": "department", "labs": "laboratories",
}
SHORT_FORMS = {k: tuple(v.split()) for k, v in SHORT_FORMS.items()}
# Words that only say that a name is an organisation's, and strings that name nobody.
FORM_WORDS = frozenset("inc incorporated ltd limited llc llp gmbh ag corp corporation co company plc sa bv oy ab pty the team group".split())
NOBODY = frozenset("|unknown|no author|noauthor|author|root|none|null|nil|na|n a|anonymous|anon|admin|administrator|user|username|name|your name|nobody|test|tbd|todo|undefined|system|localhost|ubuntu|default|me|someone|unknown author|not committed yet".split("|"))
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"})
_MAIL = re.compile(r"<[^>]*>|\([^)]*@[^)]*\)")

# Noise model: the chance that a typist turns a canonical name into a variant, by the kind of change.
CHANCE = {"full": 1.0, "short": 0.2, "initial": 0.2, "handle": 0.1, "typo": 0.05, "short typo": 0.01, "initial typo": 0.002}


def fold(text: str) -> str:
    """Lower case without marks; ``ue``, ``oe`` and ``ae`` count as the vowels with marks that they stand for."""
    text = unicodedata.normalize("NFKD", text.lower().translate(_LETTERS))
    text = "".join(c for c in text if not unicodedata.combining(c)).translate(_LETTERS)
    return re.sub(r"([uoa])e", r"\1", text)


def parse(name: str | None) -> tuple[str, str] | None:
    """``(kind, key)``: full names by their sorted words, names of one word and an initial, and handles; None for nobody."""
    if name is None:
        return None
    bare = _MAIL.sub(" ", name)
    if not re.search(r"\w", bare):
        found = re.search(r"<\s*([^@<>]+)@", name)
        bare = found[1] if found else ""
    bare = bare.split("@")[0] if re.fullmatch(r"\s*\S+@\S+\s*", bare) else bare
    bare = re.sub(r"\[bot\]", " bot", bare, flags=re.I)
    words = re.findall(r"[^\W_]+", fold(bare.replace("'", "").replace("’", "")))
    if " ".join(words) in NOBODY:
        return None
    kept = [w for w in words if w not in FORM_WORDS] or words
    long, short = sorted(w for w in kept if len(w) > 1), [w for w in kept if len(w) == 1]
    if len(long) >= 2:
        return "full", " ".join(long)
    if long and short:
        return "initial", f"{long[0]} {short[0]}"
    if long and len(long[0]) >= 3:
        return "handle", long[0]
    return ("alone", " ".join(words)) if words else None


def deletions(word: str) -> set[str]:
    """The word and the word without any one letter; words one edit or swap apart share one of them."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} if len(word) >= 4 else {word}


def offers(key: str) -> set[str]:
    """Block keys under which a full name can be found as what a variant means."""
    words = key.split()
    out = {f"K {key}"}
    for i, w in enumerate(words):
        rest = words[:i] + words[i + 1 :]
        out |= {f"D {' '.join(rest)} {d}" for d in deletions(w)}
        for o in rest:
            out |= {f"X {w} {o[0]}", f"H {o[0]}{w}", f"H {w}{o[0]}", f"H {w}{o}"}
            out |= {f"Y {d} {o[0]}" for d in deletions(w)}
    return out


def seeks(kind: str, key: str) -> dict[str, str]:
    """Block keys under which a variant looks for what it means, with the kind of change."""
    out: dict[str, str] = {}
    words = key.split()
    if kind == "full":
        for i, w in enumerate(words):
            rest = words[:i] + words[i + 1 :]
            for formal in SHORT_FORMS.get(w, ()):
                formal = fold(formal)
                out.setdefault(f"K {' '.join(sorted([formal, *rest]))}", "short")
                for j, r in enumerate(rest):
                    others = sorted([formal, *rest[:j], *rest[j + 1 :]])
                    for d in deletions(r):
                        out.setdefault(f"D {' '.join(others)} {d}", "short typo")
            for d in deletions(w):
                out.setdefault(f"D {' '.join(rest)} {d}", "typo")
    elif kind == "initial":
        out[f"X {key}"] = "initial"
        for d in deletions(words[0]):
            out.setdefault(f"Y {d} {words[1]}", "initial typo")
    elif kind == "handle":
        out[f"H {key}"] = "handle"
    return out


def near(a: str, b: str) -> bool:
    """Whether one edit or one swap of neighbours turns one word into the other."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) == len(y) >= 2 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def fits(change: str, variant: str, meant: str) -> bool:
    """The exact check of a candidate that shared a block."""
    v, m = variant.split(), meant.split()
    if change in ("typo", "short typo"):
        extra_v, extra_m = [w for w in v if w not in m], [w for w in m if w not in v]
        pairs = list(zip(sorted(extra_v), sorted(extra_m)))
        if change == "typo":
            return len(extra_v) == len(extra_m) == 1 and min(len(extra_v[0]), len(extra_m[0])) >= 4 and near(*pairs[0])
        options = [(a, b) for a in extra_v for b in extra_m]
        return any(b in map(fold, SHORT_FORMS.get(a, ())) and all(near(c, d) for c in extra_v if c != a for d in extra_m if d != b) for a, b in options)
    if change == "initial typo":
        return any(near(v[0], w) and o[0] == v[1] and v[0][-1] == w[-1] for w, o in itertools.permutations(m, 2))
    return True


@frame_stage
def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = [parse(a) for a in pdf["name"]]
        keep = [g is not None for g in got]
        yield pdf[keep].assign(kind=[g[0] for g in got if g], key=[g[1] for g in got if g])


@frame_stage
def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(s, kind, key, n, b, None) for s, kind, key, n in zip(pdf["space"], pdf["kind"], pdf["key"], pdf["n"]) if kind == "full" for b in offers(key)]
        rows += [(s, kind, key, n, b, change) for s, kind, key, n in zip(pdf["space"], pdf["kind"], pdf["key"], pdf["n"]) for b, change in seeks(kind, key).items()]
        yield pd.DataFrame(rows, columns=["space", "kind", "key", "n", "block", "change"])


@frame_stage
def _fitting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf[[fits(c, v, m) for c, v, m in zip(pdf["change"], pdf["key"], pdf["meant"])]]


def name_entities(names: DataFrame, space: str, name: str, min_posterior: float = 0.6) -> DataFrame:
    """``space, name, entity``: the spellings of each space (exactly as they stand) with the entity that each means.

    Noisy channel: spellings that differ only in case, marks, order, separators, middle initials, mail addresses or
    company forms are one form; full names are canonical candidates with their frequency as prior. A short form, an
    initial, a handle or a typo is a variant of the candidates that could have produced it, by the chance of that change.
    It is attached to the candidate of the greatest posterior (prior times chance), where that is ``min_posterior`` or
    more; a typo only to a form at least as frequent. Candidates come from block keys, so no two names are compared that
    share no block, and a space of any size is spread over tasks. Chains of attachments are followed to their ends.

    Null, empty and meaningless names mean nobody and are left out; repeated rows add to a spelling's frequency; ties go
    to the smaller key; null spaces are dropped; empty input gives no rows.
    """
    kind = names.schema[space].dataType.simpleString()
    spelled = names.where(F.col(space).isNotNull() & F.col(name).isNotNull()).groupBy(F.col(space).alias("space"), F.col(name).alias("name")).agg(F.count("*").alias("n"))
    parsed = stage(spread(spelled, shuffled=True).mapInPandas(_parsed, f"space {kind}, name string, n long, kind string, key string"))
    forms = parsed.groupBy("space", "kind", "key").agg(F.sum("n").alias("n"))
    blocks = stage(spread(forms, shuffled=True).mapInPandas(_blocks, f"space {kind}, kind string, key string, n long, block string, change string"))
    sought = blocks.where("change is not null")
    offered = blocks.where("change is null").select("space", "block", F.col("key").alias("meant"), F.col("n").alias("meant_n"))
    shared = sought.join(offered, ["space", "block"]).where("not (kind = 'full' and key = meant)")
    upward = (F.col("meant_n") > F.col("n")) | ((F.col("meant_n") == F.col("n")) & (F.col("meant") < F.col("key")))
    met = shared.where((F.col("change") != "typo") | upward).select("space", "kind", "key", "n", "change", "meant", "meant_n").distinct()
    fitting = met.mapInPandas(_fitting, met.schema)
    chance = F.coalesce(*[F.when(F.col("change") == c, F.lit(p)) for c, p in CHANCE.items()])
    weighed = stage(fitting.select("space", "kind", "key", "meant", (F.col("meant_n") * chance).alias("score")))
    own = Window.partitionBy("space", "kind", "key").orderBy(F.desc("score"), "meant")
    # the rivals of a full name's best candidate are mostly typos of the same name, so it is taken as it is
    full = weighed.where("kind = 'full'").groupBy("space", "kind", "key", "meant").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(own)).where("rank = 1")
    links = stage(full.select("space", "key", F.col("meant").alias("top")))
    for _ in range(math.ceil(math.log2(links.count() + 2))):  # each round doubles the length of the chains followed, so these end the longest
        over = links.select("space", F.col("key").alias("top"), F.col("top").alias("higher"))
        moved = stage(links.join(over, ["space", "top"], "left").select("space", "key", F.coalesce("higher", "top").alias("top"), F.col("higher").isNotNull().alias("moved")))
        links = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            break
    tops = links.select("space", F.col("key").alias("meant"), "top")
    short = weighed.where("kind <> 'full'").join(tops, ["space", "meant"], "left").groupBy("space", "kind", "key", F.coalesce("top", "meant").alias("meant")).agg(F.sum("score").alias("score"))
    share = F.col("score") / F.sum("score").over(Window.partitionBy("space", "kind", "key"))
    best = short.withColumn("posterior", share).withColumn("rank", F.row_number().over(own)).where((F.col("rank") == 1) & (F.col("posterior") >= min_posterior))
    attached = best.select("space", "kind", "key", F.col("meant").alias("top")).unionByName(links.select("space", F.lit("full").alias("kind"), "key", "top"))
    placed = parsed.join(attached, ["space", "kind", "key"], "left")
    return placed.select("space", "name", F.coalesce(F.concat(F.lit("full "), "top"), F.concat_ws(" ", "kind", "key")).alias("entity"))


def same_names(names: DataFrame, space: str, name: str) -> DataFrame:
    """``space, name_a, name_b`` (name_a < name_b): all pairs of spellings of a space that mean the same entity, as the problem asks."""
    told = stage(name_entities(names, space, name))
    other = told.select("space", "entity", F.col("name").alias("name_b"))
    return told.withColumnRenamed("name", "name_a").join(other, ["space", "entity"]).where("name_a < name_b").select("space", "name_a", "name_b")


def author_names(commits: DataFrame) -> DataFrame:
    """:func:`same_names` of the authors of a scan."""
    return same_names(commits, "scan_id", "author").withColumnRenamed("space", "scan_id")
