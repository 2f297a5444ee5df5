"""Word lists shared by the DataFrame jobs and their SQL checks."""

# Common English stop words of more than four letters (shorter words never pass the
# topic length filter).
ENGLISH_STOP_WORDS = """
about above across after afterwards again against almost alone along already although always among
amongst amoungst amount another anyhow anyone anything anyway anywhere around became because become
becomes becoming before beforehand behind being below beside besides between beyond bottom cannot
could couldnt describe detail during eight either eleven elsewhere empty enough every everyone
everything everywhere except fifteen fifty first former formerly forty found front further hasnt
hence hereafter hereby herein hereupon herself himself however hundred indeed interest itself latter
latterly least meanwhile might moreover mostly myself namely neither never nevertheless nobody noone
nothing nowhere often others otherwise ourselves perhaps please rather seemed seeming seems serious
several should since sincere sixty somehow someone something sometime sometimes somewhere still
system their themselves thence there thereafter thereby therefore therein thereupon these thick third
those though three through throughout together toward towards twelve twenty under until whatever
whence whenever where whereafter whereas whereby wherein whereupon wherever whether which while
whither whoever whole whose within without would yours yourself yourselves
""".split()

# Frequent words of social posts that say nothing about the topic.
SOCIAL_STOP_WORDS = """
https http just like dont people know think time good make want really would right going even much
about some what they when how
""".split()

# Words of the keyword scorer, matched as substrings.
POSITIVE_WORDS = "good great awesome excellent love amazing best happy".split()
NEGATIVE_WORDS = "bad terrible awful hate worst horrible sad angry".split()


def stop_words() -> list[str]:
    """Both stop lists as one sorted list without repeats."""
    return sorted(set(ENGLISH_STOP_WORDS) | set(SOCIAL_STOP_WORDS))
