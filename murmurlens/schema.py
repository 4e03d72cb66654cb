"""Fixed shapes and fixed values of the data model."""

from pyspark.sql import types as T

# Columns of the posts table, in storage order.
POSTS_SCHEMA = T.StructType(
    [
        T.StructField("post_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("selftext", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("author_fullname", T.StringType()),
        T.StructField("created_utc", T.TimestampType()),
        T.StructField("subreddit", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("ups", T.IntegerType()),
        T.StructField("downs", T.IntegerType()),
        T.StructField("num_comments", T.IntegerType()),
        T.StructField("num_crossposts", T.IntegerType()),
        T.StructField("upvote_ratio", T.DoubleType()),
        T.StructField("permalink", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("crosspost_parent", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("is_self", T.BooleanType()),
        T.StructField("over_18", T.BooleanType()),
        T.StructField("link_flair_text", T.StringType()),
        T.StructField("author_flair_text", T.StringType()),
    ]
)
POST_COLUMNS = POSTS_SCHEMA.fieldNames()

# Source keys per field, the first one present in the sample wins.
FIELD_CANDIDATES = {
    "post_id": ["id", "name"],
    "title": ["title"],
    "selftext": ["selftext", "body", "text"],
    "author": ["author", "author_fullname"],
    "created_utc": ["created_utc", "created"],
    "subreddit": ["subreddit", "subreddit_name_prefixed"],
    "score": ["score"],
    "ups": ["ups", "upvotes"],
    "downs": ["downs", "downvotes"],
    "num_comments": ["num_comments"],
    "num_crossposts": ["num_crossposts"],
    "permalink": ["permalink"],
    "url": ["url", "url_overridden_by_dest"],
    "crosspost_parent": ["crosspost_parent"],
    "over_18": ["over_18"],
    "is_self": ["is_self"],
    "link_flair_text": ["link_flair_text"],
    "author_flair_text": ["author_flair_text"],
    "domain": ["domain"],
    "upvote_ratio": ["upvote_ratio"],
}

# Accounts left out of rankings and of the graph.
EXCLUDED_AUTHORS = ["[deleted]", "AutoModerator"]

# Metrics the engagement series accepts; the first is the default.
ENGAGEMENT_METRICS = ["score", "num_comments", "num_crossposts"]
