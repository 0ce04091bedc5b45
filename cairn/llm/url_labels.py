"""A small table of labelled URLs, from which the URL filter learns."""

#: URLs invented under names that are reserved for examples, labelled by hand by what they name.
LABELLED = """
block http://casino.example/slots.html
block http://www-casino.example/jackpot
block http://casino24.test/roulette/461
block http://casino.example/blackjack/337
block http://portal-casino.example/bonus-spins/
block https://poker.example/tables/
block http://the-poker.example/freeroll/index.php
block http://pokerworld.test/deposit-bonus/
block http://betting.example/odds.html
block https://m-betting.example/live-bets/
block http://bettingworld.test/parlay/169
block http://pharma.example/cheap-pills/
block http://www-pharma.example/viagra/
block https://pharmaplace.test/no-prescription.html
block http://pills.example/order-now/
block http://blog-pills.example/discount
block https://pillsplace.test/diet
block http://xxx.example/videos/index.php
block https://best-xxx.example/cams/
block http://xxxplace.test/gallery/112
block http://porn.example/tube/
block http://the-porn.example/hd/
block https://pornonline.test/free/
block https://adult.example/dating.html
block https://best-adult.example/chat
block http://adulthub.test/webcam/858
block http://warez.example/crack
block http://portal-warez.example/keygen
block http://warez24.test/serials
block http://torrent.example/cracked/634
block https://m-torrent.example/full-rip/
block https://torrenthub.test/nulled
block http://payday.example/loans/
block http://the-payday.example/instant-cash/
block http://paydayonline.test/apply.html
block https://loans.example/bad-credit/
block http://www-loans.example/approved/index.php
block http://loanshub.test/cash/540
block https://replica.example/watches.html
block https://replica.example/handbags/
block http://replicaworld.test/outlet.html
block http://prize.example/winner
block https://m-prize.example/claim/index.php
block http://prizeworld.test/gift-card.html
block https://adserver.example/click/
block http://adserver.example/popup
block http://adserverhub.test/banner/index.php
block http://track.example/redirect/index.php
block http://best-track.example/pixel/564
block http://track24.test/offer/
block https://malware.example/download.exe/
block http://top-malware.example/setup.exe.html
block https://malwareplace.test/update.exe/
block http://phish.example/verify-account/index.php
block http://best-phish.example/login-update.html
block http://phishhub.test/password.html
block http://crypto.example/double-coins/index.php
block http://crypto.example/giveaway
block http://cryptohub.test/airdrop
block https://miracle.example/weight-loss/index.php
block http://best-miracle.example/cure/
block https://miracle24.test/slim/607
allow http://news.example/politics/
allow http://blog-news.example/economy.html
allow https://newsplace.test/weather.html
allow http://library.example/catalogue/index.php
allow https://best-library.example/opening-hours/752
allow https://library24.test/archive/
allow https://university.example/courses.html
allow http://portal-university.example/physics/108
allow https://universityonline.test/admissions
allow http://museum.example/exhibitions.html
allow https://museum.example/visit/932
allow http://museumplace.test/collection/index.php
allow https://docs.example/install
allow http://best-docs.example/reference.html
allow https://docsonline.test/tutorial/index.php
allow http://wiki.example/history/
allow https://best-wiki.example/geography.html
allow https://wikionline.test/biology
allow http://recipes.example/soup.html
allow https://www-recipes.example/bread/index.php
allow http://recipeshub.test/salads.html
allow http://garden.example/roses/909
allow http://the-garden.example/vegetables
allow https://gardenhub.test/tools
allow http://city.example/council
allow http://my-city.example/transport.html
allow https://cityonline.test/parks.html
allow https://hospital.example/departments
allow http://hospital.example/visitors/index.php
allow http://hospital24.test/cardiology/index.php
allow https://school.example/timetable/
allow https://blog-school.example/teachers
allow http://schoolworld.test/homework.html
allow https://journal.example/articles/
allow http://best-journal.example/issue-12/index.php
allow https://journalonline.test/editorial/488
allow https://code.example/repository/
allow https://m-code.example/issues/357
allow https://codeworld.test/pull-requests/
allow https://travel.example/mountains/index.php
allow http://travel.example/trains/
allow https://travelonline.test/maps/index.php
allow http://sports.example/football
allow https://sports.example/results
allow http://sports24.test/tennis.html
allow http://music.example/concerts/index.php
allow https://portal-music.example/orchestra/348
allow https://musiconline.test/scores/639
allow http://books.example/reviews/
allow http://best-books.example/authors
allow http://booksworld.test/fiction/46
allow http://science.example/astronomy.html
allow https://www-science.example/chemistry/73
allow http://science24.test/papers/
allow http://forum.example/threads
allow https://www-forum.example/questions/
allow https://forumworld.test/members.html
allow http://bakery.example/cakes.html
allow http://my-bakery.example/order/index.php
allow http://bakeryworld.test/contact/index.php
"""
