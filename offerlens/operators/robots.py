"""May a page be fetched, and how did the fetch go? Rules of robots.txt as a table, outcomes as words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions import pagetext

#: How much of a file of rules and of a page is read.
ROBOTS_BYTES = 200_000
PAGE_CHARS = 600_000


def rules(robots: DataFrame, agent: str) -> DataFrame:
    """(host, ordinal, allow, path) from robots(host, status, body): the rules of the group that speaks to the agent, or else to all.

    A group is a run of user-agent lines with the rules that follow it; an empty line ends it, and rules without user-agents before them speak to nobody.
    The first group with a rule that names the agent counts. Other answers than a file have no rules.
    """
    name = agent.split("/")[0].lower()
    lines = robots.where("status = 200").select("host", F.posexplode(F.split(F.left("body", F.lit(ROBOTS_BYTES)), r"\r\n|\r|\n")).alias("pos", "line"))
    said = lines.select("host", "pos", (F.col("line") == "").alias("empty"), F.trim(F.regexp_replace("line", "#.*$", "")).alias("line"))
    field = F.when(F.col("empty"), "").when(F.instr("line", ":") > 0, F.lower(F.trim(F.substring_index("line", ":", 1))))
    pairs = said.select("host", "pos", field.alias("field"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value")).where("field IN ('', 'user-agent', 'allow', 'disallow')")
    order = Window.partitionBy("host").orderBy("pos")  # a file, ROBOTS_BYTES at most
    opens = (F.col("field") == "") | (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    grouped = pairs.withColumn("group", F.sum(opens.cast("int")).over(order)).where("field <> ''")
    named = F.when(F.col("value") == "*", 1).when(F.lit(name).contains(F.lower("value")), 0)
    speaks = grouped.groupBy("host", "group").agg(F.min(F.when(F.col("field") == "user-agent", named)).alias("tier"), F.bool_or(F.col("field") != "user-agent").alias("rules"))
    chosen = speaks.where("rules AND tier IS NOT NULL").groupBy("host").agg(F.min(F.struct("tier", "group")).alias("g"))
    mine = grouped.join(chosen.select("host", F.col("g.group").alias("group")), ["host", "group"]).where("field <> 'user-agent'")
    # a rule against nothing allows all
    return mine.select("host", F.col("pos").alias("ordinal"), ((F.col("field") == "allow") | (F.col("value") == "")).alias("allow"), F.col("value").alias("path"))


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^#]*)", 1)
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def allowed(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """urls(url) with host, `allowed` and `refusal`, the reason in words.

    The first rule of the host whose path the url's begins with decides. To find those that do, a url is cut at the lengths that the host's
    rules have and met with them by equality, so no url is held against every rule.
    """
    own = rules(robots, agent)
    lengths = own.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))
    asked = urls.withColumn("host", pagetext.host_of(F.col("url")))
    pages = asked.select("host", "url").distinct()
    starts = pages.join(lengths, "host").select("host", "url", path_of(F.col("url")).alias("whole"), F.explode("lengths").alias("n")).where(F.length("whole") >= F.col("n"))
    hits = starts.select("host", "url", F.left("whole", F.col("n")).alias("path")).join(own, ["host", "path"])
    verdict = hits.groupBy("url").agg(F.min_by("allow", "ordinal").alias("allow"))
    # a host that shuts its rules away is obeyed as one that forbids all
    shut = robots.where("status IN (401, 403)").select("host", F.col("status").alias("shut"))
    rows = asked.join(verdict, "url", "left").join(shut, "host", "left")
    may = F.col("shut").isNull() & F.coalesce("allow", F.lit(True))
    why = F.when(F.col("shut").isNotNull(), F.concat(F.lit("robots.txt unreadable ("), F.col("shut").cast("string"), F.lit("), treated as disallow"))).when(~may, "robots.txt disallows")
    return rows.select(*urls.columns, "host", may.alias("allowed"), why.alias("refusal"))


def outcomes(fetches: DataFrame) -> DataFrame:
    """fetches with html (null if there is none) and result, how it went in words.

    fetches(allowed, refusal, first, second): each answer is (status, content_type, error, body), the second that of another client, which is asked
    where the first was told 403 and whose failure leaves the 403 as it was. The text of a PDF stands in its body.
    """
    retried = (F.col("first.status") == 403) & F.col("second.status").isNotNull() & F.col("second.error").isNull()
    rows = fetches.withColumn("a", F.when(F.coalesce(retried, F.lit(False)), F.col("second")).otherwise(F.col("first")))
    kind = F.coalesce("a.content_type", F.lit(""))
    bare = F.substring_index(kind, ";", 1)
    pdf = (F.col("a.status") == 200) & F.lower(kind).contains("pdf")
    text = F.coalesce("a.body", F.lit(""))
    read = (F.col("a.status") == 200) & kind.contains("html")
    html = F.when(F.col("allowed") & F.col("a.error").isNull(), F.when(pdf & (text != ""), F.concat(F.lit("<pre>"), F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</pre>"))).when(~pdf & read, F.left(text, F.lit(PAGE_CHARS))))
    told = rows.withColumn("html", html).withColumn("quotes", F.when(F.col("html").isNotNull(), pagetext.offer_quotes(pagetext.visible_text(F.col("html")))))
    result = (
        F.when(~F.col("allowed"), F.col("refusal")).when(F.col("a.error").isNotNull(), F.concat(F.lit("error: "), "a.error")).when(F.col("html").isNotNull(), F.concat(F.lit("ok, "), F.size("quotes").cast("string"), F.lit(" quote(s)")))
        .when(pdf, "pdf, no extractable text").otherwise(F.concat(F.col("a.status").cast("string"), F.lit(" "), F.when(bare == "", "?").otherwise(bare)))
    )
    return told.withColumn("result", result).drop("a")
