"""Coreference by carrying the last antecedent forward."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.session import lookup_join

# Pronouns and their gender, per language.
PRONOUNS = {
    "en": dict.fromkeys("he his him himself".split(), "male") | dict.fromkeys("she her hers herself".split(), "female"),
    "fr": {"il": "male", "lui": "male", "elle": "female"},
    "es": {"él": "male", "ella": "female"},
    "de": dict.fromkeys("er ihn ihm sein seine seiner seinem seinen seines".split(), "male") | dict.fromkeys("sie ihr ihre ihrem ihres ihrer".split(), "female"),
}


def pronoun_gender(alias: Column, lang: str = "en") -> Column:
    out = F.lit(None).cast("string")
    for word, gender in PRONOUNS[lang].items():
        out = F.when(F.lower(alias) == word, gender).otherwise(out)
    return out


def antecedents(mentions: DataFrame, page: str, order: list[str], entity: str = "entity", gender: str = "gender", pronoun: str = "pronoun") -> DataFrame:
    """mentions with `antecedent`: for a pronoun (its gender in column `pronoun`, null for names) the last name of that
    gender before it on the page. Names have a gender; names without one, and pronouns, start no new antecedent."""
    w = Window.partitionBy(page).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda g: F.last(F.when(F.col(pronoun).isNull() & (F.col(gender) == g), F.col(entity)), ignorenulls=True).over(w)
    rows = mentions.withColumns({"__m": last("male"), "__f": last("female")})
    return rows.withColumn("antecedent", F.when(F.col(pronoun) == "male", F.col("__m")).when(F.col(pronoun) == "female", F.col("__f"))).drop("__m", "__f")


def gender_votes(names: DataFrame, key: str, name: str, genders: DataFrame) -> DataFrame:
    """(key, male, female, gender) from the words of each name; genders: (name, gender), 'mostly_x' counting as x.

    gender is set only if all votes agree.
    """
    words = names.select(key, F.explode(F.split(name, " ")).alias("name"))
    known = genders.select("name", F.regexp_replace("gender", "^mostly_", "").alias("gender"))
    votes = lookup_join(words, known, ["name"]).groupBy(key).agg(F.count_if(F.col("gender") == "male").alias("male"), F.count_if(F.col("gender") == "female").alias("female"))
    return votes.withColumn("gender", F.when((F.col("male") > 0) & (F.col("female") == 0), "male").when((F.col("female") > 0) & (F.col("male") == 0), "female"))


def keyed_antecedents(occurrences: DataFrame, links: DataFrame, corefs: DataFrame, page: str, at: str = "at", end: str = "end") -> DataFrame:
    """Occurrences (page, at, key) with the `antecedent` that their key names there.

    A link (page, at, end, entity) declares the keys of its entity (corefs: entity, coref) from the gap in front of it
    on, until another link declares the same key.
    """
    gap = F.coalesce(F.lag(end).over(Window.partitionBy(page).orderBy(at)), F.lit(0))
    declared = lookup_join(links.withColumn("__from", gap), corefs, ["entity"], "inner")
    declared = declared.select(page, F.col("coref").alias("key"), F.col("__from").alias("__pos"), F.col(at).alias("__order"), F.col("entity").alias("__declared"))
    rows = occurrences.withColumns({"__pos": F.col(at), "__order": F.lit(None).cast("long"), "__declared": F.lit(None).cast("string")})
    w = Window.partitionBy(page, "key").orderBy(F.col("__pos"), F.col("__declared").isNull(), "__order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.withColumn("__asked", F.lit(True)).unionByName(declared, allowMissingColumns=True)
    return both.withColumn("antecedent", F.last("__declared", ignorenulls=True).over(w)).where("__asked").drop("__pos", "__order", "__declared", "__asked")


_LINK = re.compile(r"\[\[([^\[\]]*)\]\]")


def resolve_line(line: str, state: dict, corefs: dict[str, list[str]], person_gender: dict[str, str], lang: str = "en", persons: tuple[str, ...] = ("PERSON", "PER")) -> str:
    """One annotated line with pronouns and keys linked; state carries the antecedents from line to line.

    Links are [[entity|alias|tag]] or [[alias|tag]]. The pronoun of a two-part person link becomes
    [[antecedent|alias|PERSON_coref]]; a key in a gap becomes [[antecedent|key|non_person_coref]].
    """
    people, keys = state.setdefault("people", {}), state.setdefault("keys", {})
    out, at = [], 0
    for m in [*_LINK.finditer(line), None]:
        parts = m[1].split("|") if m else []
        entity = parts[0] if len(parts) > 2 else None
        person = entity and (entity in person_gender or any(parts[-1].startswith(p) for p in persons))
        if entity and not person:
            for key in corefs.get(entity, ()):
                keys[key.lower()] = entity
        gap = line[at : m.start() if m else len(line)]
        low, done, used = gap.lower(), [], 0
        found = sorted((i, -len(k), k) for k in keys for i in [p.start() for p in re.finditer(re.escape(k), low)])
        for i, _, k in found:
            if i >= used:
                done += [gap[used:i], f"[[{keys[k]}|{k}|non_person_coref]]"]
                used = i + len(k)
        out.append("".join(done) + gap[used:])
        if not m:
            break
        at = m.end()
        gender = PRONOUNS[lang].get(parts[-2].lower()) if len(parts) > 1 else None
        if len(parts) == 2 and parts[1] in persons and gender and people.get(gender):
            out.append(f"[[{people[gender]}|{parts[0]}|PERSON_coref]]")
            continue
        if person and not gender and "###" not in entity:
            g = person_gender.get(entity)
            if g:
                people[g] = entity
        out.append(m[0])
    return "".join(out)
