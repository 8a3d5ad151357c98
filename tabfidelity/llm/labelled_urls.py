"""A small labelled table for the URL filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: URLs of offers that no corpus wants (spam, gambling, pills, adult, cracks, doorways).
UNWANTED = (
    "http://www.cheap-pills.shop.test/buy/viagra-online", "http://cheap-meds.test/order/cialis.html", "http://best-casino-bonus.test/free-spins", "https://online-casino.win.test/slots/jackpot", "http://casino-royal.test/poker/bonus?ref=77",
    "http://live-sex-cams.test/girls/online", "https://free-porn-videos.test/xxx/watch.php?id=9", "http://adult-dating.test/hot-singles", "http://replica-watches.test/rolex-cheap", "http://cheap-replica-bags.test/sale/louis",
    "http://payday-loans-fast.test/apply-now", "https://easy-loans.test/no-credit-check", "http://free-crack-download.test/keygen/photo.exe", "http://warez-torrent.test/download/full-crack", "http://seo-backlinks-cheap.test/buy-links",
    "http://win-free-iphone.test/claim-prize", "http://click-here-win.test/lottery/prize", "http://forex-profit-robot.test/get-rich", "https://crypto-doubler.test/double-your-coins", "http://weight-loss-miracle.test/diet-pills",
    "http://www.buy-viagra-cheap.test/pills", "http://sports-betting-tips.test/bet365-bonus", "https://bet-online.test/odds/bonus", "http://hot-girls-webcam.test/live", "http://xxx-tube.test/porn/free",
    "http://discount-pharmacy.test/no-prescription", "http://pills-online-store.test/order", "http://get-rich-quick.test/earn-money", "http://earn-money-home.test/click", "http://free-spins-casino.test/slots",
    "http://poker-casino-bonus.test/en/play", "http://cheap-loans.test/en/apply", "http://spam-links.test/en/spam-offer", "http://buy-followers.test/instagram/cheap", "http://hacked-accounts.test/crack/free",
    "http://download-free-movies.test/torrent/hd", "http://cheap-tickets-win.test/prize", "http://escort-girls.test/city/hot", "http://sex-shop-cheap.test/buy", "http://lottery-winner.test/claim",
)
#: URLs of ordinary pages.
WANTED = (
    "https://www.library.test/en/books/history", "https://news.daily.test/2024/05/council-meeting.html", "https://blog.kitchen.test/en/recipes/bread", "https://www.university.test/physics/lectures/3", "https://docs.project.test/guide/install.html",
    "https://m.weather.test/en/forecast", "https://museum.test/exhibitions/roman-glass", "https://www.gardens.test/de/rosen/pflege.html", "https://journal.test/articles/1842", "https://en.encyclopedia.test/wiki/River",
    "https://www.city.test/services/waste?page=2", "https://forum.cycling.test/thread/881", "https://blog.travel.test/fr/voyages/alpes", "https://www.school.test/es/noticias/12", "https://parliament.test/debates/2019/11",
    "https://www.hospital.test/patients/visiting", "https://m.recipes.test/en/soup/414", "https://blog.thoughts.test/en/65.html", "https://www.theatre.test/programme/autumn", "https://geology.test/maps/sheet/41",
    "https://archive.test/letters/1790", "https://birds.test/species/heron", "https://www.trains.test/timetable?utm_source=feed", "https://astronomy.test/news/comet", "https://www.music.test/scores/bach",
    "https://blog.woodwork.test/en/joints/323.html", "https://chess.test/openings/italian", "https://www.law.test/cases/2001/7", "https://poems.test/fr/baudelaire", "https://languages.test/de/grammatik/104",
    "https://m.health.test/en/sleep#top", "https://software.test/manual/regex", "https://www.farm.test/journal/april", "https://history.test/es/roma/269", "https://blog.maths.test/proofs/primes",
    "https://www.art.test/gallery/room/5", "https://economics.test/papers/trade", "https://www.radio.test/episodes/52", "https://walks.test/routes/coast", "https://www.chemistry.test/en/elements/iron",
)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label), 1 for unwanted."""
    return spark.createDataFrame([(u, 1) for u in UNWANTED] + [(u, 0) for u in WANTED], "url string, label int")
