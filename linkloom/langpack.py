"""Language packs: the words and templates by which pages of one language edition are told apart and cleaned."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values, shared by all packs.
DASHES = ("{{spaced ndash}}", "{{dash}}", "{{snd}}", "{{spnd}}", "{{sndash}}", "{{spndash}}", "&ndash;", "&mdash;")
CONVERT_SEPARATORS = {
    "-": "-", "&ndash;": "-", "and": " and ", "and(-)": " and ", "or": " or ", "to": " to ", "to(-)": " to ", "to about": " to about ", "+/-": " ± ", "±": " ± ", "&plusmn;": " ± ",
    "+": " + ", ",": ", ", ", and": ", and ", ", or": ", or ", "by": " by ", "x": " by ", "&times;": " by ",
}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


@dataclass(frozen=True)
class LanguagePack:
    code: str
    category: str
    list_of: str
    redirect: str
    file: tuple[str, ...]
    template: str
    quote: str
    lang: tuple[str, ...]
    convert: tuple[str, ...]
    as_of: str
    infobox: str
    category_redirect: str
    cut_sections: tuple[str, ...]
    namespaces: tuple[str, ...]
    disambiguation: tuple[str, ...]
    human: tuple[str, ...]
    geo: tuple[str, ...]
    number: tuple[str, ...]
    stub: str
    given_names: tuple[str, ...]
    surnames: tuple[str, ...]
    persons: tuple[str, ...] = ("PERSON", "PER")


# Fixed values of the four language editions.
_HUMAN = ("hndis", "human name disambiguation")
_GEO = ("place name disambiguation", "geodis")
_NUMBER = ("number disambiguation", "numdab", "numberdis")

ENGLISH = LanguagePack(
    "en", "category", "list of", "redirect", ("file", "image"), "template", "quote", ("lang",), ("convert", "cvt"), "as of", "infobox", "category redirect",
    ("See also", "References", "Bibliography", "Sources", "Notes", "Further Reading", "External links"),
    ("wikipedia", "category", "file", "portal", "template", "mediawiki", "user", "help", "book", "draft", "wikiproject", "special", "talk", "image", "module", "gadget", "timedtext", "media"),
    ("set index article", "sia", "disambiguation", "disamb", "disambig", "dab", "disambiguation cleanup"), _HUMAN, _GEO, _NUMBER, "stub}}",
    ("{{given name}}", "[[Category:Given names]]", "[[Category:Masculine given names]]", "[[Category:Feminine given names]]"), ("{{surname}}", "[[Category:Surnames]]"),
)
FRENCH = LanguagePack(
    "fr", "catégorie", "liste ", "redirect", ("fichier", "file", "image"), "modèle", "citation", ("langue",), ("conversion",), "as of", "infobox", "catégorie redirect",
    ("Voir aussi", "Notes et références", "Notes", "Références", "Bibliographie", "Annexes", "Liens externes"),
    ("discussion", "utilisateur", "wikipédia", "fichier", "mediawiki", "modèle", "aide", "catégorie", "portail", "projet", "référence", "module", "sujet", "category", "file", "image", "template"),
    ("homonymie",), ("homonymie de personnes",), ("toponymie",), _NUMBER, "ébauche}}",
    ("{{prénom}}", "[[Catégorie:Prénom]]", "[[Catégorie:Prénom masculin]]", "[[Catégorie:Prénom féminin]]"), ("{{patronymie}}", "[[Catégorie:Patronyme]]"),
)
SPANISH = LanguagePack(
    "es", "categoría", "lista ", "redir", ("archivo", "imagen", "file", "image"), "plantilla", "cita", ("lengua",), ("convert",), "as of", "infobox", "categoría redirigida",
    ("Obra literaria", "Véase también", "Referencias", "Bibliografía", "Notas", "Enlaces externos"),
    ("usuario", "discusión", "wikipédia", "archivo", "imagen", "mediawiki", "plantilla", "ayuda", "categoría", "portal", "wikiproyecto", "anexo", "módulo", "accesorio", "category", "file", "image", "template"),
    ("desambiguación",), _HUMAN, _GEO, _NUMBER, "esbozo}}",
    ("{{nombre}}", "[[Categoría:Nombres propios]]", "[[Categoría:Nombres femeninos]]", "[[Categoría:Nombres masculinos]]"), ("{{apellidos}}", "[[Categoría:Apellidos]]"),
)
GERMAN = LanguagePack(
    "de", "kategorie", "liste ", "weiterleitung", ("datei", "bild", "file", "image"), "vorlage", "zitat", ("lang",), ("einheitenumrechnung",), "as of", "infobox", "kategorie weiterleitungshinweis",
    ("Siehe auch", "Literatur", "Weblinks", "Anmerkungen", "Quellen", "Einzelnachweise"),
    ("diskussion", "benutzer", "wikipedia", "datei", "bild", "mediawiki", "vorlage", "hilfe", "kategorie", "portal", "modul", "gadget", "thema", "spezial", "medium", "category", "file", "image", "template"),
    ("begriffsklärung",), _HUMAN, _GEO, _NUMBER, "lückenhaft}}",
    ("{{given name}}", "[[Kategorie:Vorname]]", "[[Kategorie:Männlicher Vorname]]", "[[Kategorie:Weiblicher Vorname]]"), ("{{surname}}", "[[Kategorie:Familienname]]"),
)

PACKS = {p.code: p for p in (ENGLISH, FRENCH, SPANISH, GERMAN)}
