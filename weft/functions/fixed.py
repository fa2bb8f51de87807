"""Lists, labels and patterns that results depend on, as they are defined for the corpus studied."""

#: fixed values: the token patterns
WORDS = r"[a-z0-9]+(?:'[a-z]+)?"
LETTERS = r"[A-Za-z]+(?:['’][A-Za-z]+)*"
POSSESSIVE = r"['’]s$"
CAPITALS = r"[A-Za-z][A-Za-z'-]*"

#: fixed values: a heading follows two empty lines; the prose ends before the first of CUT
HEADING = r"\n\n\n([^\n]{1,70})\n"
CUT = ["References", "External links", "See also", "Notes", "Further reading", "Bibliography", "Sources"]

#: fixed values: top-level headings and the sections that they open
SECTIONS = {
    "Publication history": "Publication history",
    "Publishing history": "Publication history",
    "Creation": "Creation",
    "Development": "Creation",
    "Concept and creation": "Creation",
    "Conception and creation": "Creation",
    "Artistic conception": "Creation",
    "Fictional character biography": "Fictional character biography",
    "Character history": "Fictional character biography",
    "Biography": "Fictional character biography",
    "Mainstream versions": "Fictional character biography",
    "Powers and abilities": "Powers and abilities",
    "Abilities": "Powers and abilities",
    "Characterization": "Characterization",
    "Personality": "Characterization",
    "Supporting characters": "Supporting characters",
    "Enemies": "Supporting characters",
    "Other versions": "Other versions",
    "Alternate versions": "Other versions",
    "In other media": "In other media",
    "Merchandise": "In other media",
    "Reception": "Reception",
    "Cultural impact and legacy": "Reception",
    "Literary reception": "Reception",
    "Accolades": "Reception",
    "Collected editions": "Collected editions",
}
#: fixed values: beginnings of headings, the first that fits decides
SECTION_PREFIXES = [
    ("Alternate versions", "Other versions"),
    ("Other versions", "Other versions"),
    ("Reception", "Reception"),
    ("Powers", "Powers and abilities"),
    ("Supporting", "Supporting characters"),
    ("Personality", "Characterization"),
    ("Publication", "Publication history"),
    ("Publishing", "Publication history"),
    ("In other media", "In other media"),
    ("Fictional character", "Fictional character biography"),
    ("Concept", "Creation"),
    ("Creation", "Creation"),
]
LEAD = "Lead"
#: fixed values: sections that are not searched, and those that tell the story
SKIPPED = ["In other media"]
STORY = ["Lead", "Fictional character biography", "Powers and abilities", "Characterization", "Supporting characters", "Other versions"]

#: fixed values: the end of a sentence, what must follow it, and what before a full stop ends none
SENTENCE_END = "[.!?]"
SENTENCE_CLOSERS = "[\"'”)]*"
SENTENCE_OPENERS = '[A-Z"“(]'
ABBREVIATIONS = ["Dr", "Mr", "Mrs", "Ms", "St", "Jr", "Sr", "vs", "Vol", "No", r"U\.S", "Lt", "Sgt", "Capt", "Gen", "Prof", "[A-Z]"]

#: fixed values: what decides about a name
NAME_CAP = 0.5
ORDINARY = 3
SHARE_WIN = 3
DROP = ["Justice"]
GENERIC_QUALIFIERS = ["character", "characters", "comics", "Marvel Comics", "Marvel"]
GENERIC_SUFFIX = r"\s*\((?:character|characters|comics|Marvel Comics|Marvel)\)$"
VARIANT = "Ultimate|film|Mangaverse|Guardians of the Galaxy"
OWN_WORD = "^[A-Z][a-z'’-]{2,}$"
OWN_STOP = [
    "The", "Doctor", "Captain", "Black", "Red", "White", "Blue", "Iron", "Spider", "Man", "Woman", "Girl", "Boy",
    "Kid", "Lord", "Agent", "Mister", "Miss", "King", "Queen", "Prince", "Princess", "Professor", "Marvel", "Dr", "Jr",
]
TITLE_WORDS = r"^(?:The |Your )?(?:Amazing|Spectacular|Sensational|Incredible|Savage|Uncanny|Astonishing|Friendly|Fantastic)\b"
MANTLE = r"\b(?:name|alias|code ?name|identity)\b[^.]{0,30}\b(?:of|used by)\b[^.]{0,12}\b(?:several|two|three|multiple|various|a number|different)\b"

#: fixed values: a name between these is part of a title
TITLE_BEFORE = (
    r"(?:Amazing|Spectacular|Sensational|Incredible|Savage|Uncanny|Astonishing|Ultimate|Superior|"
    r"Untold Tales of|Web of|Marvel Team-Up|Marvel Two-in-One|Friendly Neighborhood|"
    r"Immortal|Mighty|All-New|Totally Awesome|Champions|Rampaging|Adventures of|Tales of|Annual|Project:|Codename:|Hotel)\s+$|"
    r"[A-Za-z]/$|&\s+$"
)
TITLE_AFTER = (
    r"^(?:(?:\s*(?:\(vol\.?\s*\d+\)|vol\.?\s*\d+|Vol\.?\s*\d+))?\s*(?:#\s*\d|Annual|Unlimited|Team-Up|and Power Pack|"
    r"Noir\b|2099|Family|Magazine|Comics\b)|:\s|/[A-Z]|\s+&\s|\s\d\b|\s+and (?:His Amazing Friends|the Agents of)|"
    r"(?:\s+(?:and|of|the|&|[A-Z][\w'’-]*)){1,4}\s*#\s*\d|\s+(?:School|Academy|Institute|Force|Club|Corps)\b)"
)
#: fixed values: capitalised words on either side, and those that don't make a longer name
GLUE_BEFORE = r"(?<![\w-])([A-Z][\w'’.-]*) (?:of (?:the )?)?$"
GLUE_AFTER = r"^ (?:of (?:the )?)?([A-Z][\w'’.-]*)"
GLUE_NEXT = r"^ ([A-Z][\w'’.-]*)"
FUNCTION = [
    "when", "after", "while", "although", "though", "however", "meanwhile", "later", "eventually", "soon",
    "despite", "during", "before", "following", "unlike", "like", "with", "without", "both", "then", "now", "but",
    "and", "or", "as", "at", "in", "on", "by", "for", "from", "to", "the", "a", "an", "has", "had", "is", "was",
]

#: fixed values: places of links from the strongest (an unknown place comes after all), and prefixes of targets that are no pages
PLACES = ["prose", "list", "table", "image caption", "template", "infobox", "italic title", "reference"]
NAMESPACES = ["File", "Image", "Category", "Wikipedia", "Help", "Template"]
#: fixed values: each reason of the ledger with its code and family
REASONS = [
    ("both", "ok", "agree"),
    ("a shared codename we give to another page", "cg", "codename"),
    ("a shared codename we leave unresolved", "cu", "codename"),
    ("the page's own codename, which we read as the page itself", "co", "codename"),
    ("linked from other words", "ow", "words"),
    ("only in a comic title or a reference", "tr", "notprose"),
    ("only in the infobox", "ib", "notprose"),
    ("only in a table or caption", "tc", "notprose"),
    ("only in In other media, which we leave out", "om", "media"),
    ("named, but our matcher missed it", "mm", "missed"),
    ("the name is linked to another of our pages", "li", "holder"),
    ("the name is linked to a page outside the 303", "lo", "outside"),
    ("never linked on this page", "nl", "never"),
]
MISSING = "missing from the snapshot source"
