"""A small table of labelled urls, written by hand, that the url model learns from.

Urls to block name gambling, pills, adult content, loans, prizes, tracking or malware;
the others are what a reader would look for.  Many allowed hosts say nothing at
all, as most hosts do, so a host needs a reason to be blocked.
"""

BLOCK = """
http://www.lucky-casino.com/en/ https://casino-royal.net/slots http://play.online-casino.org/de/ https://bestcasino24.com/bonus http://casinospin.net/
https://win-jackpot.com/en/play http://jackpot-city.net/spin.html https://free-spins.org/slots/ http://megaslots.com/en/1 https://slot-machine.net/fr/
https://bet-now.com/en/odds http://betting-tips.net/live http://freebet.org/bonus https://sports-bets.com/de/ http://www.bets365day.net/join
https://poker-stars-win.com/ http://poker.big-money.net/table https://roulette-online.org/es/ http://bingo-cash.com/en/win https://lotto-winner.net/claim
http://cheap-viagra.com/buy https://pills-online.net/order http://www.buy-pills.org/en/ https://discount-pharmacy.com/pills http://cialis-shop.net/de/buy
https://no-prescription-meds.com/ http://diet-pills.org/fr/ https://cheap-meds24.net/order.html http://pharma-deal.com/en/pills https://weight-loss-pill.net/
http://hot-girls.com/cam https://xxx-videos.net/en/ http://adult-dating.org/join https://sexy-cams.com/live http://free-porn.net/watch
https://escort-night.com/de/ http://nude-pics.org/ https://xxx-chat.net/fr/ http://milf-dates.com/signup https://adult-tube.org/en/1.html
http://fast-loans.com/apply https://payday-loan.net/en/ http://easy-credit-cash.org/now https://quick-cash.com/loan http://debt-free-now.net/offer
https://free-prize.com/claim http://you-won-iphone.net/ https://gift-card-winner.org/claim http://win-a-prize.com/en/ https://free-gift.net/click
http://ads-click.com/banner https://track-pixel.net/ad.js http://adserver.org/banner.html https://popup-ads.com/en/ http://click-tracker.net/ads
https://free-crack.com/download http://keygen-serial.net/ https://warez-torrent.org/dl http://hack-tool.com/free https://download-virus-fix.net/exe
http://replica-watches.com/buy https://cheap-rolex.net/ http://fake-id.org/order https://bitcoin-doubler.com/invest http://crypto-profit.net/en/win
https://get-rich-quick.com/ http://work-from-home-cash.net/ https://seo-backlinks.org/buy http://buy-followers.com/cheap https://spam-mailer.net/
"""

ALLOW = """
https://www.city-library.org/en/books http://museum.example.org/fr/collection https://university.edu/courses/physics http://school-district.org/calendar
https://weather.example.com/de/berlin http://news.example.net/en/2024/politics https://daily-times.com/article/812 http://blog.gardening.org/roses.html
https://recipes.example.com/soup/tomato http://cooking-at-home.net/bread https://docs.python-guide.org/en/tutorial http://wiki.example.org/History_of_Rome
https://maps.example.com/route http://train-timetable.org/de/ https://hospital.example.org/visit http://government.example.org/forms/tax
https://forum.linux-users.net/thread/99 http://code.example.com/project/readme https://science-journal.org/en/vol12 http://astronomy.club/meeting
https://music-school.net/piano http://orchestra.org/fr/concerts https://theatre.example.com/programme http://film-review.net/1950
https://football-club.example.org/results http://hiking-trails.com/alps https://cycling.example.net/es/routes http://chess-club.org/openings
https://parents-forum.net/sleep http://pets.example.com/dogs https://birdwatch.org/species http://farmers-market.net/opening
https://bookshop.example.com/novels http://furniture-maker.com/chairs https://bakery.example.net/de/brot http://hotel-lake.com/rooms
https://travel-notes.org/japan http://photo-album.net/2019 https://history-podcast.com/ep/44 http://language-course.org/spanish
https://law-faculty.edu/library http://engineering.example.org/bridges https://chemistry.example.net/en/acids http://maths.example.com/proofs.html
https://architecture.org/fr/ http://local-radio.net/shows https://volunteer.example.org/join-us http://church-choir.org/
https://m.river.example.com/en/12 http://www.stone.example.net/de/88 https://blog.winter.example.org/fr/301 http://table.example.com/es/5
https://m.haldor.example.com/en/101 http://www.merrin.example.net/de/4402 https://blog.soltan.example.org/fr/7 http://verrow.example.com/es/33.html
https://theral.example.com/en/4512 http://www.ingoth.example.org/fr/8080 https://m.orland.example.net/de/17 http://blog.estwyn.example.com/es/902
https://tharen.example.net/en/64?page=2 http://m.ondrel.example.org/es/1999 https://www.hathor.example.com/fr/6.html http://entish.example.org/de/312
https://reston.example.com/fr/1175 http://www.alerin.example.net/es/20 https://blog.ithane.example.org/en/777/ http://m.ronthe.example.com/de/45
https://lyndor.example.org/es/3 http://m.wheral.example.net/fr/619 https://www.tionar.example.com/en/28 http://shalen.example.com/fr/90
https://andrel.example.com/es/501 http://blog.hesten.example.com/es/76 https://m.nderin.example.com/fr/240 http://edwhin.example.net/en/11
https://ouling.example.org/en/9 http://www.readle.example.com/en/130 https://quiet-garden.example.net/de/2 http://old-mill.example.org/en/history
https://north-bridge.com/council http://green-valley.net/events https://open-data.example.org/en/sets http://paper-craft.com/fold
https://garden-tools.com/spade http://sewing-room.net/patterns https://kids-science.org/volcano http://harbour-town.com/es/ferry
https://election-results.example.org/2020 http://court-records.example.com/ https://census.example.net/en/tables http://tide-tables.org/
"""


def labelled_urls() -> list[tuple[str, str]]:
    """(url, verdict) of the table."""
    return [(url, verdict) for text, verdict in ((BLOCK, "block"), (ALLOW, "allow")) for url in text.split()]
