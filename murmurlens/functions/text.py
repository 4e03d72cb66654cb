"""Text expressions: clipping, tokens, labels, digests and message templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmurlens.functions.clean import strip

# Words that never name a topic.
STOP_WORDS = [
    "this", "that", "with", "from", "your", "what", "have", "they", "will", "would",
    "about", "there", "just", "like", "when", "their", "more", "people", "some", "them",
    "how", "why", "who", "which",
]

# Message texts.
NO_RESULTS = 'No results found for the query: "%s"'
SEARCH_DIGEST = 'Found %d posts related to "%s" across %d subreddits.'
NO_SERIES = 'No time series data available for "%s".'
SERIES_DIGEST = 'The query "%s" returned %d posts. Peak activity was on %s with %d posts.'
NETWORK_FACTS = (
    "Network analysis reveals:\n- %d accounts involved\n- %d interactions\n"
    "- Top influencer: u/%s (PageRank: %.4f)\n- %d distinct communities detected\n"
)
NO_CASE = "Insufficient data to generate a case study narrative."
CASE_DIGEST = 'Analysis of "%s" reveals discussion across %d subreddits involving %d unique authors.'
EMPTY_QUERY = "Query cannot be empty"
SHORT_QUERY = (
    "Very short query ('%s'). Results may be broad. "
    "Try a more descriptive query for better results."
)
FOLLOW_UPS_WITH_HITS = [
    "How are communities responding to %s?",
    "Key influencers discussing %s",
    "Timeline of %s discussions",
]
FOLLOW_UPS_WITHOUT_HITS = ["Related topics to '%s'", "People discussing '%s'"]
GENERIC_LABELS = ["Mixed Discussions", "Topic Group", "Uncategorized"]


def clip(text: Column, width: int) -> Column:
    """The first ``width`` characters; null becomes empty."""
    return F.substring(F.coalesce(text, F.lit("")), 1, width)


def word_pieces(text: Column) -> Column:
    """Lower-case pieces of a text in order. A piece is bounded by anything but letters, digits and
    underscore of any script, so letters with accents never split a word in two."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}_]+")


def is_topic_word(piece: Column) -> Column:
    """Four or more plain letters and not a stop-word."""
    return piece.rlike("^[a-z]{4,}$") & ~piece.isin(*STOP_WORDS)


def keyword_label(words: Column, community: Column) -> Column:
    """``Word & Word Discussions`` from an array of words, ``r/community Topics`` when empty."""
    titled = F.transform(words, lambda w: F.initcap(w))
    from_words = F.concat(F.array_join(titled, " & "), F.lit(" Discussions"))
    from_community = F.concat(F.lit("r/"), F.coalesce(community, F.lit("Mixed")), F.lit(" Topics"))
    return F.when(F.size(words) > 0, from_words).otherwise(from_community)


def tidy_label(label: Column) -> Column:
    """Drop surrounding blanks and quotes; labels of more than seven words keep their first five."""
    bare = strip(F.btrim(F.btrim(strip(label), F.lit('"')), F.lit("'")))
    words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > 7, F.array_join(F.slice(words, 1, 5), " ")).otherwise(bare)


def parse_suggestions(text: Column, least: int = 6, most: int = 3) -> Column:
    """Lines of at least ``least`` characters, trimmed, the first ``most`` of them."""
    lines = F.transform(F.split(text, "\n"), strip)
    return F.slice(F.filter(lines, lambda line: F.length(line) >= least), 1, most)


def follow_ups(query: Column, has_hits: Column) -> Column:
    def fill(templates: list[str]) -> Column:
        return F.array(*[F.format_string(template, query) for template in templates])

    return F.when(has_hits, fill(FOLLOW_UPS_WITH_HITS)).otherwise(fill(FOLLOW_UPS_WITHOUT_HITS))


def suggestions_or_default(text: Column, query: Column) -> Column:
    """Suggestions found in a generated text, else the templates for a query with hits."""
    parsed = parse_suggestions(F.coalesce(text, F.lit("")))
    return F.when(F.size(parsed) > 0, parsed).otherwise(follow_ups(query, F.lit(True)))


def search_digest(query: Column, hits: Column, communities: Column) -> Column:
    return F.when(hits > 0, F.format_string(SEARCH_DIGEST, hits, query, communities)).otherwise(
        F.format_string(NO_RESULTS, query)
    )


def series_digest(label: Column, total: Column, peak_date: Column, peak_count: Column) -> Column:
    return F.when(
        peak_date.isNotNull(),
        F.format_string(SERIES_DIGEST, label, total, peak_date.cast("string"), peak_count),
    ).otherwise(F.format_string(NO_SERIES, label))


def case_digest(topic: Column, posts: Column, communities: Column, authors: Column) -> Column:
    return F.when(posts > 0, F.format_string(CASE_DIGEST, topic, communities, authors)).otherwise(F.lit(NO_CASE))


def similarity_percent(similarity: Column) -> Column:
    return F.round(similarity * 100, 1)


def query_error(text: Column) -> Column:
    return F.when(F.length(F.coalesce(strip(text), F.lit(""))) == 0, F.lit(EMPTY_QUERY))


def query_warning(text: Column) -> Column:
    cleaned = strip(text)
    return F.when(F.length(cleaned).between(1, 2), F.format_string(SHORT_QUERY, cleaned))


def text_to_encode(text: Column) -> Column:
    """Blank text is encoded as a fixed placeholder."""
    return F.when(F.length(F.coalesce(strip(text), F.lit(""))) == 0, F.lit("[empty]")).otherwise(text)


def stamp(moment: Column) -> Column:
    """UTC time as text; microseconds only where there are any."""
    has_fraction = F.date_format(moment, "SSSSSS") != "000000"
    whole = F.date_format(moment, "yyyy-MM-dd HH:mm:ss")
    return F.concat(
        F.when(has_fraction, F.concat(whole, F.lit("."), F.date_format(moment, "SSSSSS"))).otherwise(whole),
        F.lit("+00:00"),
    )


def story_block(post: Column) -> Column:
    """Text block of one key post of a case study."""
    return F.format_string(
        "[%s] r/%s by u/%s (score: %d)\n  Title: %s\n  Content: %s",
        F.coalesce(stamp(post["created_utc"]), F.lit("N/A")), post["subreddit"], post["author"], post["score"],
        clip(post["title"], 120), clip(post["content"], 200),
    )


def network_facts(accounts: Column, links: Column, top: Column, rank: Column, communities: Column) -> Column:
    return F.format_string(NETWORK_FACTS, accounts, links, F.coalesce(top, F.lit("N/A")), rank, communities)
