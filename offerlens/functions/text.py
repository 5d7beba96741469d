"""Addresses, names and other short strings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Street words that carry no distinction once number and ZIP agree.
SUFFIXES = (
    "st street ave av avenue rd road dr drive blvd boulevard ln lane pike pk ct court cir circle pl place ter terrace way hwy highway tpke turnpike "
    "sq square row trl trail run path walk expy pkwy parkway ext extension loop bypass byp"
).split()
DIRECTIONALS = "n s e w ne nw se sw north south east west".split()
#: The one spelling of words that sources spell differently.
SPELLINGS = {
    "street": "st", "avenue": "ave", "road": "rd", "drive": "dr", "boulevard": "blvd", "lane": "ln", "court": "ct", "place": "pl",
    "square": "sq", "pike": "pk", "highway": "hwy", "parkway": "pkwy", "mount": "mt", "saint": "st", "fort": "ft", "junior": "jr",
}
#: Words that a business name may have or lack.
NAME_NOISE = (
    "the a an and of inc llc lp co corp company ltd llp pa restaurant bar grill grille tavern pub brewing brewery taproom cafe kitchen house group "
    "holdings enterprises associates partners"
).split()
#: What begins a unit within an address.
UNITS = "ste suite unit apt fl floor rm room bsmt basement space bldg building store stores terminal".split()


def blank_to_null(x: Column) -> Column:
    return F.when(x != "", x)


def first_filled(*xs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(x) for x in xs])


def words(x: Column) -> Column:
    """Lower-case words, with anything but letters, digits, underscores and spaces as a break."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\w\s]", " "), r"\s+"), "")


def street_core(street: Column) -> Column:
    """`W Lancaster Avenue` and `LANCASTER AVE` are both `lancaster`; only one trailing suffix goes."""
    kept = F.filter(words(street), lambda w: ~w.isin(*DIRECTIONALS))
    last = F.try_element_at(kept, F.lit(-1))
    short = F.when((F.size(kept) > 1) & last.isin(*SUFFIXES), F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(kept)

    def spelled(w: Column) -> Column:
        out = w
        for long, brief in SPELLINGS.items():
            out = F.when(w == long, F.lit(brief)).otherwise(out)
        return out

    return F.array_join(F.transform(short, spelled), " ")


def name_core(name: Column) -> Column:
    return F.array_join(name_words(name), " ")


def name_words(name: Column) -> Column:
    return F.filter(words(name), lambda w: ~w.isin(*NAME_NOISE))


def names_agree(a: Column, b: Column) -> Column:
    """Do the names share a distinctive word?"""
    return F.arrays_overlap(name_words(a), name_words(b))


#: What ends an address behind its last comma that can be read so: town, state, ZIP.
_TAIL = r",\s*" + r"\s+".join(("(.+?)", "([A-Z]{2})", "([0-9]{5})"))


def registry_key(address: Column) -> Column:
    """struct(zip, number, core) of a registry address, null if it can't be read: the last number that words follow, units cut off."""
    zip_code, head = F.regexp_extract(address, _TAIL, 3), F.regexp_extract(address, r"^(.*?)" + _TAIL, 1)
    opening = r"^.*(?<![\d-])\b(\d+)(?:-\d+)?[A-Za-z]?\s+(?=[A-Za-z])"
    number = F.regexp_extract(head, opening, 1)
    rest = F.regexp_replace(F.regexp_replace(head, opening, ""), r"(?i)\b(?:" + "|".join([*UNITS, "#"]) + r")\b.*$", "")
    core = street_core(rest)
    found = (zip_code != "") & (number != "") & (core != "")
    return F.when(found, F.struct(zip_code.alias("zip"), number.alias("number"), core.alias("core")))


def address_signature(address: Column) -> Column:
    """`number|zip` with ? for what is missing."""
    number, zip_code = F.regexp_extract(F.coalesce(address, F.lit("")), r"^\s*(\d+)", 1), F.regexp_extract(F.coalesce(address, F.lit("")), r"(\d{5})", 1)
    return F.concat_ws("|", first_filled(number, F.lit("?")), first_filled(zip_code, F.lit("?")))


def house_number(address: Column) -> Column:
    """`30-32 E State St` starts at `30`."""
    return F.regexp_replace(address, r"^(\d+)\s*-\s*\d+\b", "$1")


def split_address(address: Column) -> Column:
    pattern = "^(.*?)" + _TAIL
    return F.struct(*[F.regexp_extract(address, pattern, i + 1).alias(n) for i, n in enumerate(("street", "city", "state", "zip"))])


#: What a street number's street ends in.
NUMBER_SUFFIXES = "st street rd road blvd boulevard pike pk ave avenue dr drive ln lane way hwy highway ct court pl place tpke turnpike cir circle".split()


def street_number(address: Column) -> Column:
    """The first number that a street suffix follows before any comma, else a leading one."""
    near = F.regexp_extract(address, r"(?i)\b(\d+)\b(?=[^,]*\b(?:" + "|".join(NUMBER_SUFFIXES) + r")\b)", 1)
    return first_filled(near, F.regexp_extract(address, r"^\s*(\d+)", 1))


PLACE_NOISE = r"(?i)\b(?:inc|llc|lp|llp|co|corp|company|restaurants?|the|of|at)\b|#\s*\d+|\d+"


def place_tokens(name: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), PLACE_NOISE, " ")), "[^a-z0-9 ]", " ")
    return F.array_distinct(F.array_remove(F.split(plain, " +"), ""))


def zips(address: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(address, F.lit("")), F.lit(r"\b(\d{5})(?:-\d{4})?\b"), F.lit(1)))


def places_agree(name_a: Column, name_b: Column, address_a: Column, address_b: Column) -> Column:
    """One name's tokens hold the other's, with something in common, in the same ZIP."""
    a, b = place_tokens(name_a), place_tokens(name_b)
    within = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    signal = (F.least(F.size(a), F.size(b)) >= 2) | F.arrays_overlap(a, b)
    return (F.size(a) > 0) & (F.size(b) > 0) & within & signal & F.arrays_overlap(zips(address_a), zips(address_b))


def is_geocode(place_name: Column, website: Column, n_photos: Column, address: Column) -> Column:
    """A place that is the address itself: no site, no photos, and a name that starts with the street number."""
    number = street_number(address)
    return blank_to_null(F.coalesce(website, F.lit(""))).isNull() & (F.coalesce(n_photos, F.lit(0)) == 0) & F.coalesce(F.startswith(F.trim(place_name), number), F.lit(False))


def slug(name: Column, city: Column) -> Column:
    raw = F.regexp_replace(F.lower(F.concat_ws(" ", name, city)), r"[^a-z0-9]+", "-")
    return F.left(F.regexp_replace(raw, r"^-+|-+$", ""), F.lit(60))


#: Company words, connectives, and names too general to guess a host from.
CORPORATE = (
    "inc llc lp llp corp corporation co company ltd holdings holdco enterprises associates partners group hospitality management ventures pa usa restaurants"
).split()
GLUE = "and the of at on for".split()
GENERIC = "the bar pub tavern inn grill grille cafe restaurant club house kitchen brewery brewing taproom lounge hotel".split()
GENERIC_NAMES = [*GENERIC, "the bar", "the pub", "the inn"]


def clean_name(name: Column) -> Column:
    """Lower case without store numbers, company words and punctuation; & is `and`."""
    numberless = F.regexp_replace(F.coalesce(name, F.lit("")), r"\s*#\s*\d+\s*$|\s+\d{4,}\s*$", "")
    plain = F.regexp_replace(F.lower(numberless), r"[^\w\s&']", " ")
    plain = F.replace(F.replace(plain, F.lit("&"), F.lit(" and ")), F.lit("'"), F.lit(""))
    plain = F.regexp_replace(plain, r"\b(?:l l c|" + "|".join(sorted(CORPORATE, key=len, reverse=True)) + r")\b\.?", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def domain_stems(name: Column) -> Column:
    """Up to four host stems, likeliest first: the words run together, with and without `the`, and without a last general word."""
    clean = clean_name(name)
    parts = F.array_remove(F.split(clean, " "), "")
    first, last = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(-1))
    other = F.when(first == "the", F.slice(parts, 2, 100)).otherwise(F.concat(F.array(F.lit("the")), parts))

    def forms(words_: Column) -> Column:
        n = F.size(words_)
        shorter = F.when((n > 2) & F.try_element_at(words_, F.lit(-1)).isin(*GENERIC_NAMES), F.array_join(F.slice(words_, 1, F.greatest(n - 1, F.lit(1))), "")).otherwise("")
        return F.array(F.array_join(words_, ""), shorter)

    stems = F.transform(F.concat(forms(parts), forms(other)), lambda s: F.regexp_replace(s, "[^a-z0-9]", ""))
    good = F.array_distinct(F.filter(stems, lambda s: (F.length(s) >= 6) & ~s.rlike(r"^\d+$")))
    address = first.rlike(r"^\d+$") & last.isin(*SUFFIXES)
    refused = (F.size(parts) == 0) | clean.isin(*GENERIC_NAMES) | ~F.exists(parts, lambda w: w.rlike("[a-z]")) | address
    return F.when(refused, F.array().cast("array<string>")).otherwise(F.slice(good, 1, 4))


def proof_words(name: Column) -> Column:
    return F.filter(F.array_remove(F.split(clean_name(name), " "), ""), lambda w: (F.length(w) > 2) & ~w.isin(*GENERIC_NAMES) & ~w.isin(*GLUE))


#: Phrases of parked and of placeholder pages.
PARKED = (
    r"domain (?:is )?(?:for sale|parking)|buy this domain|this domain is|parked (?:free )?(?:at|by|courtesy)|godaddy\.com/domainsearch|hugedomains|sedoparking|"
    r"namecheap\.com/domains|expired domain|website is currently unavailable|account suspended|default web page|welcome to nginx|apache2 ubuntu default"
)
PLACEHOLDER = r"coming soon|under construction"
PLACEHOLDER_CHARS = 1500


def proven(page: Column, named: Column, places: Column) -> Column:
    """The evidence that a page is a venue's own: every word of its name, and a place; null if it proves nothing."""
    low = F.replace(F.replace(normal(page), F.lit("’"), F.lit("")), F.lit("'"), F.lit(""))
    held = F.forall(named, lambda w: F.regexp_like(low, F.concat(F.lit(r"\b"), w)))
    place = F.try_element_at(F.filter(places, lambda p: (p != "") & F.contains(low, p)), F.lit(1))
    parked = F.left(low, F.lit(4000)).rlike(PARKED) | ((F.length(low) < PLACEHOLDER_CHARS) & low.rlike(PLACEHOLDER))
    ok = ~parked & (F.size(named) > 0) & held & place.isNotNull()
    return F.when(ok, F.concat(F.lit("name("), F.array_join(named, "+"), F.lit(") + "), place))


def registrable(host: Column) -> Column:
    """The last two labels of a host, without its port."""
    labels = F.split(F.regexp_replace(F.lower(host), r":\d+$", ""), r"\.")
    return F.when(F.size(labels) < 2, F.array_join(labels, ".")).otherwise(F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))


#: Entity suffixes that go, words that stay upper and lower case.
ENTITY = (
    r"(?i)[\s,]+(?:LLC|L\.L\.C\.|INC|INC\.|LP|L\.P\.|LLP|LTD|CORP|CORPORATION|CO|COMPANY|ASSOCIATES|ENTERPRISES|HOLDINGS|GROUP|PARTNERS|PARTNERSHIP)\.?$"
)
KEPT_UPPER = "bbq byob kop llc ii iii iv vi vii viii ix nyc pa usa vfw dj tv jr sr bmw".split()
KEPT_LOWER = "a an and at by de del for in la las los of on or the to y".split()
KEPT_PLACES = ("PA", "NE", "NW", "SE", "SW")


def _capitals(word: Column, breaks: str) -> Column:
    """word with the first letter of each of its pieces in upper case."""
    return F.array_join(F.transform(F.split(word, breaks), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))), "")


def pretty_name(name: Column) -> Column:
    """An all-capitals registry name as a person would write it; any other keeps its case."""
    raw = F.trim(F.coalesce(name, F.lit("")))
    short = F.regexp_replace(raw, ENTITY, "")
    base = F.when(short == "", raw).otherwise(short)

    def cased(word: Column, place: Column) -> Column:
        low = F.lower(word)
        bare = F.regexp_replace(low, "^[.,&'\"()]+|[.,&'\"()]+$", "")
        # an apostrophe is part of the word when letters stand on both sides
        return F.when(bare.isin(*KEPT_UPPER), F.upper(word)).when(bare.isin(*KEPT_LOWER) & (place > 0), low).otherwise(_capitals(low, r"(?<=[^a-z'])|(?<=(?:^|[^a-z])')"))

    words_ = F.array_remove(F.split(base, r"\s+"), "")
    return F.when(base.rlike("[a-z]"), base).otherwise(F.array_join(F.transform(words_, cased), " "))


def pretty_address(address: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(address, F.lit(""))), r"\b(\d{5})-\d{4}\b", "$1"), r"\s{2,}", " ")
    runs = F.split(plain, r"(?<=[^A-Za-z])(?=[A-Za-z])|(?<=[A-Za-z])(?=[^A-Za-z])")
    cased = F.transform(runs, lambda w: F.when(F.upper(w).isin(*KEPT_PLACES), w).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))))
    return F.when(plain.rlike("[a-z]"), plain).otherwise(F.array_join(cased, ""))


def normal(x: Column) -> Column:
    """Lower case, single spaces: the form in which evidence is looked up."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")))


def hue(x: Column) -> Column:
    """A colour angle for an id: h * 31 + code, modulo 360."""
    codes = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(0), lambda h, c: ((h * 31 + c) % 360).cast("int"))


def monogram(x: Column) -> Column:
    return F.upper(F.regexp_extract(F.coalesce(x, F.lit("")), r"([A-Za-z0-9])", 1))


def directions_url(lat: Column, lng: Column, address: Column) -> Column:
    """A route to the point, or to the address where there is none."""
    point = F.concat(lat.cast("string"), F.lit(","), lng.cast("string"))
    target = F.when(lat.isNotNull() & lng.isNotNull(), point).otherwise(F.regexp_replace(F.url_encode(address), r"\+", "%20"))
    return F.concat(F.lit("https://www.google.com/maps/dir/?api=1&destination="), target)


def salted_hash(salt: str, x: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{salt}:"), x), 256)
