"""Fixed values that must equal the established ones for right results."""

# Keyword list of the rule classifier, alphabetical.
ATTACK_TERMS = (
    "access acl admin advisory allow arbitrary aslr assurance attack auth buffer bug "
    "bypass certificate code command corruption csrf cve cyber denial deployment "
    "dereference disclosure execute exploit hack heap identity injection interception "
    "leak overflow privilege remote root scripting security stack threat "
    "unauthenticated vuln xss"
).split()

# Text patterns. In URL_PATTERN "+-=" inside the class is a range. Whitespace
# is spelled out where the shorthand inside a class makes the regex engine many times slower.
URL_PATTERN = (
    r"((https?|ftp|gopher|telnet|file|Unsure|http):((//)|(\\))+"
    r"[\w\d:#@%/;$()~_?\+-=\\\.&]*)"
)
ESCAPE_PATTERN = r"(\\)+[\w]*"
OTHER_CHARACTERS_PATTERN = r"[^ \t\n\x0B\f\r^a-z]"
SPACES_PATTERN = r"\s{2,}|[\t\n\x0B\f\r]"

# English number words.
UNIT_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen "
    "fourteen fifteen sixteen seventeen eighteen nineteen"
).split()
TENS_WORDS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALE_WORDS = ["billion", "million", "thousand", ""]

# Cohesion needed for a cluster to be final, listing separator, cutoff day.
COHESION_THRESHOLD = 2.0 / 3.0
LISTING_SEPARATOR = "%%%%%%%%%%%%%%%%%%%%%%%%%%%%%"
CUTOFF_DAY = "2016-04-01"
