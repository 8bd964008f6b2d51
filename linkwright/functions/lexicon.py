"""Word lists that normalisation depends on."""

# Legal forms and related words of business names, long to short.
NAME_WORDS = {
    "corporation": "corp",
    "company": "co",
    "incorporated": "inc",
    "limited": "ltd",
    "private": "pvt",
    "enterprises": "ent",
    "enterprise": "ent",
    "industries": "ind",
    "industry": "ind",
    "international": "intl",
    "associates": "assoc",
    "brothers": "bros",
    "and": "&",
}

# Words of addresses, long to short.
ADDRESS_WORDS = {
    "road": "rd",
    "street": "st",
    "avenue": "ave",
    "boulevard": "blvd",
    "lane": "ln",
    "drive": "dr",
    "circle": "cir",
    "court": "ct",
    "place": "pl",
    "square": "sq",
    "floor": "fl",
    "building": "bldg",
    "apartment": "apt",
    "suite": "ste",
    "north": "n",
    "south": "s",
    "east": "e",
    "west": "w",
    "saint": "st",
    "opposite": "opp",
}

# Words that an address loses after its words are shortened.
ADDRESS_STOPWORDS = ("near", "opp", "opposite", "behind", "next", "to", "the")

# Other names of countries, after cleaning.
COUNTRIES = {
    "us": "united states",
    "usa": "united states",
    "u s a": "united states",
    "united states of america": "united states",
    "in": "india",
    "fr": "france",
}

# Texts that mean no value.
NO_VALUE = ("nan", "none", "")

# Consonants by phonetic class.
SOUND_CLASSES = {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}

#: Country of a record that has none, in keys.
UNKNOWN_COUNTRY = "__unknown__"
