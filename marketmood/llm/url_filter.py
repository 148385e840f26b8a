"""URL filters: allow and block rules, then logistic regression on hashed character n-grams.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
end, A-Z lower-cased; the path what follows up to ``?``, ``#`` or the end. A
null URL or one without ``://`` has both empty. A rule ``host/path`` fits its
host and all subdomains, if the URL's path starts with the rule's (with its
slash); the longest fitting rule decides. URLs that no rule fits are judged by
a logistic regression on hashed 3- to 5-grams of host and path, trained from a
small labelled URL table, which is a parameter. The table here names real kinds
of hosts; ``held_out_accuracy`` trains on a part of it and judges the rest.
"""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketmood.llm.common import free_name, read_table

# Rules of the query (fixed values): verdict by host and path.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

# Labelled URLs (fixed values): gambling, adult, file-sharing, advertising, pills, loans, replicas and spam, and ordinary ones.
BLOCKED = """
betfair.com/sport  www.unibet.com/betting/odds  betway.com/en/sports  bet-at-home.com/  m.bwin.com/en/  sportsbetting.ag/live  mybet.de/
www.williamhill.com/casino  888casino.com/  leovegas.com/en/casino  casinoeuro.com/slots  royal-casino-bonus.net/  www.slotomania.com/slots
partypoker.com/play  ggpoker.eu/  www.888poker.com/poker/play  onlinepoker.net/freeroll  lottoland.co.uk/lotto  bingo-jackpot.biz/win
win-real-money-online.biz/  roulette77.com/  bestbets.info/tips  www.oddschecker-bets.net/  jackpotcity.com/slots  free-spins-casino.org/
xnxx.com/  xhamster.com/videos  www.pornhub.com/view_video  redtube.com/  youporn.com/  chaturbate.com/cams  livejasmin.com/  xtube.com/video
xxxbunker.com/  sexvideos.tv/free  hotsexcams.net/live  adultfriendfinder.com/  www.adultwork.com/  xxxvidz.net/videos  nudevista.com/
milf-dates.com/  hookup-tonight.net/adult  freeporn-videos.biz/  escort-girls.info/  fapvideos.net/
pirateproxy.live/  piratebays.co/search  1337x.to/  kickasstorrents.to/  www.torrentz2.eu/  limetorrents.info/  yts.mx/torrent  rarbg.to/torrents.php
torrentdownloads.me/  warez-bb.org/  crackedsoftware.org/download  keygenguru.com/  serialkeys.net/crack  nulledscripts.to/  putlockerhd.is/watch
free-movies-online.cc/  cracksmod.com/  allcracks.net/  torlock.com/  proxybay.one/
doubleclick.net/ads  adnxs.com/  pagead2.googlesyndication.com/pagead  adsrvr.org/track  popads.net/  propellerads.com/  exoclick.com/ad
ads.yahoo.com/click  adserver.example-media.com/  tracking.admarketplace.net/  adroll.com/pixel  trackingpixel.io/t.gif  clickbank-ads.com/
popunder.net/  adclickserver.com/adclick  banner-exchange.biz/  track.adform.net/adfserve  media-ads.org/
buy-viagra-online.com/  cheapmeds24.net/pills  canadianpharmacy-online.net/  diet-pills-reviews.biz/  generic-cialis.org/order
weightloss-pills.info/  onlinepharmacy365.com/meds  no-prescription-meds.biz/
payday-loans-now.com/apply  instant-cash-advance.net/  bad-credit-loans.biz/  quick-loans24.com/  get-rich-fast.info/
replica-watches.co/rolex  cheap-handbags-outlet.biz/  fake-rolex.net/
seo-backlinks.biz/  linkfarm-network.com/  article-spam.net/  spammers-list.org/  free-gift-cards.win/  you-won-prize.club/claim
free-iphone-giveaway.top/  cheap-followers.net/buy  spam-blaster.com/
""".split()
ALLOWED = """
/  en.wikipedia.org/wiki/History  www.bbc.co.uk/news/world  nytimes.com/section/science  www.theguardian.com/environment  reuters.com/markets
stackoverflow.com/questions/11227809  github.com/apache/spark  docs.python.org/3/library  developer.mozilla.org/en-US/docs  arxiv.org/abs/1706.03762
www.nature.com/articles  sciencedirect.com/journal  pubmed.ncbi.nlm.nih.gov/  www.who.int/health-topics  nasa.gov/missions  mit.edu/courses
www.essex.ac.uk/departments  sussex.ac.uk/study  ox.ac.uk/admissions  www.stanford.edu/  uni-heidelberg.de/de/studium  sorbonne-universite.fr/
elpais.com/cultura  www.lemonde.fr/politique  spiegel.de/wissenschaft  corriere.it/cronache  www.dn.se/nyheter  asahi.com/articles
youtube.com/watch  vimeo.com/channels  www.imdb.com/title  spotify.com/album  www.ted.com/talks  goodreads.com/book  gutenberg.org/ebooks
www.theatlantic.com/ideas  theverge.com/tech  thelancet.com/journals  thenational.scot/news  theconversation.com/articles  thestar.com/news
amazon.com/dp  www.ikea.com/de/  etsy.com/listing  bestbuy.com/site  www.target.com/  betterhomes.com/recipes  adobe.com/products  www.adidas.com/
allrecipes.com/recipe  bbcgoodfood.com/recipes  www.seriouseats.com/  epicurious.com/  chefkoch.de/rezepte  marmiton.org/recettes
lonelyplanet.com/spain  www.tripadvisor.com/Hotels  airbnb.com/rooms  booking.com/hotel  expedia.com/Flights  visitscotland.com/
www.mayoclinic.org/diseases  nhs.uk/conditions  webmd.com/drugs  cancer.gov/types  www.redcross.org/donate  unicef.org/
chase.com/personal  www.bankofengland.co.uk/  irs.gov/forms  europa.eu/legislation  www.gov.uk/tax  loc.gov/collections  archives.gov/research
weather.gov/forecast  www.nationalgeographic.com/animals  britannica.com/topic  merriam-webster.com/dictionary  duolingo.com/course
khanacademy.org/math  coursera.org/learn  www.scholastic.com/  gardenersworld.com/plants  rhs.org.uk/advice  betterplaceproject.org/
espn.com/nba/standings  www.fifa.com/tournaments  olympics.com/en/athletes  cricinfo.com/series  cyclingnews.com/races  alphabet.com/investors
pillsbury.com/recipes  www.philharmonie.com/en/concerts  moma.org/exhibitions  rijksmuseum.nl/en/collection  news.ycombinator.com/item
theathletic.com/football  thingiverse.com/things  thermofisher.com/order  leatherman.com/tools  motherjones.com/politics  northeastern.edu/
playstation.com/games  nationwide.com/insurance  actionaid.org/  www.strath.ac.uk/  rotherham.gov.uk/council  conservation.org/  theregister.com/
foundationcenter.org/  www.stationers.org/  southernwater.co.uk/  thonhotels.com/  weatherford.com/  gatherer.wizards.com/  blog.mozilla.org/en/
""".split()

# Fixed values of the variants that a row is trained with.
SUBDOMAINS = ("", "", "www.", "m.", "blog.")
TOPS = ("com", "net", "org", "de", "fr", "example.com", "example.net", "example.org")
PATHS = ("/", "/en/#", "/de/#.html", "/fr/#/", "/es/#", "/index.html", "/item/#")

BUCKETS = 1 << 22


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits (of equally long ones the first in order), or null."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return F.lit(None).cast("string") if out is None else out


def features(host: str, path: str) -> np.ndarray:
    """Buckets of the distinct 3- to 5-grams of the marked host and path."""
    grams = {zlib.crc32(f"{side}{marked[i:i + n]}".encode()) % BUCKETS
             for side, marked in (("h", f"^{host}$"), ("p", f"^{path}$"))
             for n in (3, 4, 5) for i in range(max(1, len(marked) - n + 1))}
    return np.array(sorted(grams))


def variants(urls: list[tuple[str, str, int]], count: int, seed: int = 7) -> list[tuple[str, str, int]]:
    """Each row, and ``count`` more of its host under other subdomains and top-level domains and with other paths.

    What a host is doesn't hang on these, so the model learns it from its name.
    """
    rng, out = random.Random(seed), list(urls)
    for host, path, label in urls:
        name = re.sub(r"^(www|m|en|blog)\.", "", host)
        name, dot, top = name.rpartition(".")
        for _ in range(count if name else 0):
            out.append((rng.choice(SUBDOMAINS) + name + dot + rng.choice((top, *TOPS)),
                        rng.choice((path, *PATHS)).replace("#", str(rng.randrange(10_000))), label))
    return out


def train(urls: list[tuple[str, str, int]], rounds: int = 500, rate: float = 30.0, decay: float = 1e-4,
          allow_weight: float = 1.0, more: int = 6) -> tuple[dict[int, float], float]:
    """Weights (by bucket) and bias by gradient descent on (host, path, label 1 = block) and ``variants``; none without rows.

    Rows to be allowed weigh ``allow_weight`` times as much as others.
    """
    urls = variants(urls, more)
    rows = [features(h, p) for h, p, _ in urls]
    if not rows:
        return {}, 0.0
    sizes = np.array([len(r) for r in rows])
    seen, at = np.unique(np.concatenate(rows), return_inverse=True)
    row, scale = np.repeat(np.arange(len(rows)), sizes), np.repeat(1 / np.sqrt(sizes), sizes)
    y = np.array([label for _, _, label in urls], np.float64)
    share = np.where(y == 1, 1.0, allow_weight)
    share /= share.sum()
    weights, bias = np.zeros(len(seen)), 0.0
    for _ in range(rounds):
        z = np.bincount(row, weights[at] * scale, len(rows)) + bias
        miss = (1 / (1 + np.exp(-z)) - y) * share
        weights -= rate * (np.bincount(at, miss[row] * scale, len(seen)) + decay * weights)
        bias -= rate / 20 * miss.sum()
    return dict(zip(seen.tolist(), weights.tolist())), float(bias)


def block_score(host: str, path: str, weights: dict[int, float], bias: float) -> float:
    """Probability that the URL is to be blocked."""
    found = features(host, path)
    return float(1 / (1 + np.exp(-(sum(weights.get(f, 0.0) for f in found.tolist()) / np.sqrt(len(found)) + bias))))


def labelled() -> list[tuple[str, str, int]]:
    """Host, path and label of the table; a lone slash stands for an empty host and path."""
    split = lambda u: ("", "") if u == "/" else (u.partition("/")[0], "/" + u.partition("/")[2])
    return [(*split(u), 1) for u in BLOCKED] + [(*split(u), 0) for u in ALLOWED]


def held_out_accuracy(urls: list[tuple[str, str, int]], folds: int = 5) -> dict[int, float]:
    """By label, the share judged right of URLs that the model was not trained on; every row is held out once."""
    right = {0: [], 1: []}
    for k in range(folds):
        model = train([u for i, u in enumerate(urls) if i % folds != k])
        for i, (h, p, y) in enumerate(urls):
            if i % folds == k:
                right[y].append((block_score(h, p, *model) >= 0.5) == bool(y))
    return {y: sum(r) / max(len(r), 1) for y, r in right.items()}


def judge(pages: DataFrame, rules: dict[str, str] = RULES, urls: list[tuple[str, str, int]] | None = None,
          url: str = "url", cut: float = 0.5) -> DataFrame:
    """All rows and columns of ``pages`` with host, path, rule, block_score and verdict.

    Every row is judged, nulls and repeats included; ``block_score`` is the
    model's probability whether or not a rule decides. Columns of these names
    are replaced.
    """
    weights, bias = train(labelled() if urls is None else urls)
    data = pages.drop(*[c for c in ("host", "path", "rule", "block_score", "verdict") if c != url])
    h, p = free_name(data, "url_host"), free_name(data, "url_path")

    @F.pandas_udf("double")
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([block_score(a, b, weights, bias) for a, b in zip(hosts, paths)], dtype="float64")

    out = data.withColumn(h, host_of(F.col(url))).withColumn(p, path_of(F.col(url)))
    rule = longest_rule(F.col(h), F.col(p), rules)
    ruled = F.lit(None).cast("string")
    for name, verdict in rules.items():
        ruled = F.when(F.col("rule") == name, verdict).otherwise(ruled)
    kept = [F.col(f"`{c}`") for c in data.columns]
    return (out.select(*kept, F.col(h).alias("host"), F.col(p).alias("path"), rule.alias("rule"),
                       score(h, p).alias("block_score"))
            .withColumn("verdict", F.coalesce(ruled, F.when(F.col("block_score") >= cut, "block").otherwise("allow"))))


def op8_url_filter(spark, sf_dir) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")
