"""URL filter: rules by host and path, and a logistic regression on hashed character n-grams for the rest.

DataFrame functions and ``pyspark.ml`` only.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.llm import common

#: (verdict, rule): host, slash, start of the path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Lengths of the character n-grams, and buckets that they are hashed to.
GRAMS, BUCKETS = (3, 4, 5), 1 << 14
#: Verdict of the model: block at this probability or above.
BLOCK_AT = 0.5

# Small labelled table: hosts and paths that are typical of unwanted pages, and of ordinary ones.  Some ordinary ones hold
# words that unwanted ones like (order, login, free, play).
BLOCKED = tuple(
    "casino-win.com/en/1.html online-casino.net/slots best-casino-bonus.org/play poker-room.com/login poker-stars-win.net/de/7 "
    "cheap-pills.com/buy cheap-pills.net/en/22.html buy-viagra-online.com/ pharmacy-discount.net/pills pills-store.org/order "
    "xxx-videos.com/watch adult-cams.net/live hot-sex-chat.com/en porn-tube.net/video free-xxx.org/adult "
    "payday-loans.com/apply fast-cash-loan.net/loan easy-credit-loans.org/money win-big-money.com/bet bet-sport-win.net/odds "
    "replica-watches.com/shop cheap-rolex.net/buy crack-serial.com/download warez-keygen.net/crack torrent-free-movies.com/watch "
    "lottery-winner.com/claim free-prize-win.net/claim lucky-slots.com/spin spin-win-casino.org/fr/9 bet-casino.example.com/de/4 "
    "seo-backlinks.net/buy cheap-traffic.com/seo spam-links.org/free click-here-now.com/free-offer malware-update.net/exe "
    "phishing-bank-login.com/verify secure-login-verify.net/account dating-hot-girls.com/chat escort-city.net/adult gamble-king.com/win "
    "m.royal-casino-slots.com/spin www.discount-pills-order.net/buy blog.free-adult-videos.com/watch shop.replica-bags-cheap.com/buy "
    "live.poker-bonus-win.net/play my.quick-payday-cash.org/apply promo.lottery-jackpot-win.com/claim get.free-keygen-crack.net/download "
    "www.sexcams-online.org/live en.betting-odds-casino.com/bet login.bank-verify-secure.com/update buy.backlinks-seo-cheap.com/links".split())
ORDINARY = tuple(
    "university.edu/research/paper news-daily.com/2020/article library.org/books/12 museum.org/en/exhibits science-journal.com/articles/7 "
    "blog.example.com/en/posts/3 weather.net/en/today city-council.org/services school.example.net/fr/classes hospital.org/health/info "
    "docs.python-guide.org/library wiki.example.org/fr/history recipes.com/en/soup travel-guide.net/de/berlin garden-tips.com/plants "
    "history.org/de/1848 music-school.net/lessons theatre.org/programme football-club.com/news chess.org/openings "
    "open-data.net/datasets maps.example.com/en/4 nature-park.org/trails local-paper.com/opinion/55.html tech-review.net/en/reviews/9 "
    "photo-club.org/gallery encyclopedia.com/fr/article dictionary.net/en/word forum.example.org/topic/81 support.example.com/help/2 "
    "railway.com/timetable bakery.net/bread cycling.org/en/tours cinema.com/films university-press.net/titles "
    "archive.org/en/records parliament.org/debates astronomy.net/stars www.botany-society.org/journal/4 m.city-library.net/books/12 "
    "blog.mountain-trails.com/posts/3 en.art-history.org/article/18 news.harbour-times.com/2019/economy docs.open-maps.org/guide/5 "
    "www.primary-school.net/classes/music forum.woodworking.org/topic/81 support.printer-manuals.com/help/2 de.bird-watching.net/species "
    "www.cooking-at-home.com/fr/soup events.town-hall.org/calendar data.river-levels.net/stations/9 shop.garden-seeds.com/order/beans "
    "my.health-service.org/account/letters www.chess-academy.com/play/openings tickets.national-theatre.org/buy/seats "
    "download.free-software.org/releases www.savings-bank.com/login insurance-advice.org/money/pensions sport-results.net/odds-and-ends".split())


#: Subdomains and paths that say nothing.  Words of each class's hosts, put together anew, stand with them, so that they weigh
#: alike in both classes and words weigh more than the hosts that hold them.
NEUTRAL = tuple(zip("www. m. blog. www. m. en.".split(), "en/1.html fr/9 de/4 es/22.html en/45 index.html".split()))


def host_of(url: Column) -> Column:
    """From the first ``://`` to a slash, question mark, hash or the end, A-Z in lower case; empty without ``://`` or url."""
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null without one.  A rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, name in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # a longer one takes the place of a shorter one
        rule_host, _, rest = name.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, own).otherwise(verdict)
    return rule, verdict


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of the host without port and of the path, told apart by a prefix; digits count as one sign."""
    def of(text: Column, mark: str) -> Column:
        framed = F.concat(F.lit("^"), F.regexp_replace(F.lower(text), "[0-9]+", "0"), F.lit("$"))
        return F.concat(*(F.when(F.length(framed) >= n, F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(framed) - n + 1, F.lit(1))), lambda i, n=n: F.concat(F.lit(mark), framed.substr(i, F.lit(n)))))
            .otherwise(F.array().cast("array<string>")) for n in GRAMS))

    return F.concat(of(F.regexp_replace(host, ":[0-9]*$", ""), "h"), of(path, "p"))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled table: ``host``, ``path``, ``label`` (1: unwanted)."""
    rows = []
    for label, urls in ((1.0, BLOCKED), (0.0, ORDINARY)):
        words = [w for u in urls for w in u.partition("/")[0].rpartition(".")[0].replace(".", "-").split("-") if len(w) > 3]
        for k, u in enumerate(urls):
            host, _, path = u.partition("/")
            before, neutral = NEUTRAL[k % len(NEUTRAL)]
            other = f"{words[2 * k % len(words)]}-{words[(2 * k + 7) % len(words)]}.{('com', 'net', 'org')[k % 3]}"
            rows += [(host, "/" + path, label), (before + other, "/" + neutral, label)]
    values = ", ".join(f"('{h}', '{p}', {y}D)" for h, p, y in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, label)")


def fit(labelled: DataFrame) -> PipelineModel:
    """Logistic regression with a quadratic penalty on binary bucket features; the table is small by contract."""
    rows = labelled.select(grams(F.col("host"), F.col("path")).alias("grams"), "label").coalesce(1)
    return Pipeline(stages=[
        HashingTF(inputCol="grams", outputCol="features", numFeatures=BUCKETS, binary=True),
        LogisticRegression(maxIter=50, regParam=0.005, standardization=False),
    ]).fit(rows)


def judge(pages: DataFrame, model: PipelineModel, key: str = "page_id", url: str = "url",
          rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict`` and the model's ``block_score`` of every row.

    A null url, or one without ``://``, has an empty host and path, meets no rule and is judged by the model.
    """
    from pyspark.ml.functions import vector_to_array

    rows = pages.select(pages[key].alias("key"), F.coalesce(pages[url].cast("string"), F.lit("")).alias("url"))
    parts = rows.select("key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = model.transform(parts.withColumn("grams", grams(F.col("host"), F.col("path"))))
    score = vector_to_array("probability")[1]
    return scored.select(
        "key", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(score >= BLOCK_AT, "block").otherwise("allow")).alias("verdict"),
        score.alias("block_score")).withColumnRenamed("key", key)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(common.read(spark, sf_dir, "pages"), fit(labelled_urls(spark)))
    return judged.select("page_id", "host", "path", "rule", "verdict")
