"""Learns the weights of pii.py: python -m faultline.llm.pii_train

Labelled texts are composed from carriers, invented names and written forms of each kind, and from texts that look alike but hold
nothing personal. The objective is the conditional log-likelihood of the gold segmentation over the lattice of candidates; expected feature counts come
from a forward and a backward pass over segment ends. Everything is drawn from one seed. N_TEXTS bounds the labelled sample.
"""

from __future__ import annotations

import json
import math
import random
from collections import Counter, defaultdict
from pathlib import Path

from faultline.llm import pii

SEED, N_TEXTS, EPOCHS, RATE, DECAY = 7, 12000, 8, 0.12, 1e-4
#: How much the ending of a word may speak against a name at most.
LEAST_ENDING = -1.0
#: Share of the invented names that the lexicon knows while learning.
KNOWN = 0.3

GIVEN = {"en": [a + b for a in ("Al", "Ber", "Cor", "Dan", "El", "Fen", "Gar", "Hol", "Jor", "Kes", "Lor", "Mer", "Nor", "Ol", "Per", "Ros", "Sel", "Tam", "Win")
                for b in ("ma", "ton", "in", "iel", "sie", "na", "rick", "lis", "a", "ter", "ra", "an", "ric")],
         "de": [a + b for a in ("An", "Ber", "Det", "Fal", "Ger", "Hau", "Im", "Jo", "Kas", "Lie", "Mal", "Rei", "Sil", "Thi") for b in ("selm", "trun", "lev", "ko", "lind", "ke", "na", "te", "mund", "lo")],
         "ru": "Анна Борис Вера Глеб Дарья Егор Жанна Захар Илья Кира Лев Мария Никита Олег Павел Роман Софья Тимур Ульяна Фёдор Юрий Яна Тихон Лада Игнат Злата Мирон Остап Римма Ефим".split()}
FAMILY = {"en": [a + b for a in ("Ash", "Brad", "Cal", "Dun", "East", "Fair", "Had", "Kel", "Lang", "Mar", "Nor", "Pel", "Red", "Sel", "Thorn", "Wex", "Quar", "Vell", "Tarn") for b in ("wick", "stane", "combe", "mere", "low", "ton", "ham", "ley", "field", "ford", "well")],
          "de": [a + b for a in ("Alt", "Berg", "Dorn", "Eich", "Fels", "Grün", "Halm", "Kräh", "Linden", "Moor", "Nuss", "Rosen", "Stolz", "Wiesen") for b in ("auer", "hagen", "feldt", "brink", "mann", "bach", "stein", "er")],
          "ru": [a + b for a in ("Бор", "Ветр", "Град", "Дрём", "Ельн", "Зар", "Кремн", "Луг", "Мшар", "Озёр", "Прибор", "Студен", "Туман", "Вельк") for b in ("ов", "ин", "енко", "овцев", "ова", "ина", "овцева", "евский")]}
PATRONYMIC = "Глебович Ефимович Тихонович Мироновна Ефимовна Борисович Олеговна Романович Юрьевна Павловна".split()
HOSTS = ["mail.example", "corp.example", "inbox.invalid", "x1.mail.example", "post.firma.test", "pochta.gorod.test", "kunden.werk.example", "office.example.org", "example.com"]
TOWN = {"en": ["Marrowby", "Pellford", "Kingsbeck", "Dunholt", "West Harrow"], "de": ["Altfelden", "Neudornau", "Bad Ahlbruck", "Moorhausen"], "ru": ["Ольхов", "Заречинск", "Камнегорск", "Нижний Брод"]}


def _d(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def part(r: random.Random, words: list[str], held: bool) -> str:
    """A name part: one in five is only ever in held-out texts."""
    return r.choice([w for i, w in enumerate(words) if (i % 5 == 3) == held])


def name(r: random.Random, lang: str, held: bool = False) -> str:
    g, f = part(r, GIVEN[lang], held), part(r, FAMILY[lang], held)
    if lang == "ru":
        p = r.choice(PATRONYMIC)
        x = r.choice([f"{f} {g}", f"{g} {f}", f"{f} {g} {p}", f"{g} {p} {f}", f"{f} {g[0]}.{p[0]}.", f"{g[0]}. {f}", f"{f} {g[0]}. {p[0]}.", f"{g[0]}.{p[0]}. {f}", f"{f} {g[0]}."])
    else:
        m = r.choice("ABCDEFGKLMRST")
        if r.random() < 0.2:
            f += "-" + part(r, FAMILY[lang], held)
        x = r.choice([f"{g} {f}", f"{g} {f}", f"{g} {m}. {f}", f"{g[0]}. {f}", f"{f}, {g}", f"{g[0]}. {m}. {f}", f"{f}, {g[0]}."])
    if r.random() < 0.12 and "." not in x:
        x = x.upper()
    return x


def email(r: random.Random) -> str:
    u = r.choice(["{g}.{f}", "{f}{n}", "{f}-{g}", "{i}{f}", "{g}_{f}", "{g}{n}", "{g}.{f}+{t}"]).format(
        g=r.choice(GIVEN["en"]).lower(), f=r.choice(FAMILY["en"]).lower(), i="x", n=_d(r, r.choice([2, 4])), t=r.choice(["pay7", "orders", "refund"]))
    h = r.choice(HOSTS)
    x = r.choice([f"{u}@{h}"] * 5 + [f"{u} @ {h}", f"{u}(at){h.replace('.', '(dot)')}", f"{u} [at] {h}", f"{u} at {h.replace('.', ' dot ')}", f"{u}%40{h}"])
    return x.upper() if r.random() < 0.05 and " at " not in x else x


def phone(r: random.Random, lang: str) -> str:
    a, b, c = _d(r, 3), _d(r, 3), _d(r, 4)
    if lang == "ru":
        p, q = c[:2], c[2:]
        return r.choice([f"+7 {a} {b}-{p}-{q}", f"+7({a}){b}{c}", f"+7{a}{b}{c}", f"8 {a} {b} {c}", f"8 ({a}) {b}-{p}-{q}", f"8-{a}-{b}-{p}-{q}", f"+7 {a} {b} {p} {q}", f"+7 ({a}) {b}-{p}-{q}", f"8{a}{b}{c}"])
    if lang == "de":
        z = r.choice(["30", "40", "89", "221"])
        n = _d(r, 5)
        return r.choice([f"0{z}/{n}{b}", f"0049 {z} {n}{b}", f"0{z} {n}-{b}", f"(0{z}) {n}{b}", f"+49 (0){z} {n} {b}", f"+49 {z} {n}{b}", f"+49 {z} {n} {b}", f"+49{z}{n}{b}"])
    a = r.choice("23456789") + a[1:]
    return r.choice([f"({a}) {b}-{c}", f"{a} {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1-{a}-{b}-{c}", f"+1 {a} {b} {c}", f"+1{a}{b}{c}", f"+44 7{a} {b}{c[:3]}", f"+44 (0)7{a} {b}{c[:3]}", f"07{a} {b}{c[:3]}", f"+447{a}{b}{c[:3]}"])


def person_id(r: random.Random, lang: str) -> str:
    if lang == "ru":
        return r.choice([f"{_d(r, 3)}-{_d(r, 3)}-{_d(r, 3)} {_d(r, 2)}", f"{_d(r, 2)} {_d(r, 2)} {_d(r, 6)}", f"ИНН {_d(r, 12)}", f"ИНН: {_d(r, 12)}", f"инн {_d(r, 12)}", f"СНИЛС {_d(r, 11)}", f"паспорт {_d(r, 4)} {_d(r, 6)}", f"паспорт {_d(r, 2)} {_d(r, 2)} {_d(r, 6)}"])
    if lang == "de":
        p = r.choice("CFGHJKLMRT") + _d(r, 2) + r.choice("CFGHJKL") + _d(r, 5)
        return r.choice([f"Steuer-ID {_d(r, 11)}", f"Steuer-ID {_d(r, 2)} {_d(r, 3)} {_d(r, 3)} {_d(r, 3)}", f"Personalausweis {p}", f"Ausweisnummer {p}", f"Ausweis-Nr. {p}", f"Reisepass {p}"])
    return r.choice([f"{_d(r, 3)}-{_d(r, 2)}-{_d(r, 4)}", f"SSN {_d(r, 9)}", f"SSN: {_d(r, 9)}", f"ssn={_d(r, 9)}", f"QQ {_d(r, 2)} {_d(r, 2)} {_d(r, 2)} {r.choice('ABCD')}", f"passport {_d(r, 9)}", f"passport no. {_d(r, 9)}", f"Passport: {_d(r, 9)}"])


def address(r: random.Random, lang: str) -> str:
    n, t = r.randint(1, 199), r.choice(TOWN[lang])
    if lang == "ru":
        s, w = r.choice([("Луговая", "улица"), ("Ольховая", "улица"), ("Кузнечная", "улица")]), r.choice(["пер. Паромщиков", "пр-т Маяков", "пр-т Трёх Сосен"])
        x = r.choice([f"ул. {s[0]}, д. {n}", f"ул. {s[0]}, {n}", f"улица {s[0]} {n}к2", f"{s[0]} улица, дом {n}", f"{w}, {n}", f"{w}, д.{n}"])
        return r.choice(["", f"{_d(r, 6)}, г. {t}, ", f"г. {t}, ", ""]) + x + r.choice(["", f", кв. {n}"])
    if lang == "de":
        s = r.choice(["Ziegel", "Birken", "Erlen", "Anger", "Mühl"]) + r.choice(["straße", "str.", "weg", "platz", "allee", "ufer", "gasse"])
        return r.choice([f"{s} {n}", f"{s} {n}a", f"{_d(r, 5)} {t}, {s} {n}", f"{s} {n}, {_d(r, 5)} {t}", f"{s} {n}, {t}"])
    s = r.choice(["Mill Pond", "Old Quarry", "Ferry", "Weavers", "Larkspur", "Bramble"]) + " " + r.choice(["Street", "St.", "Lane", "Road", "Ave", "Avenue", "Drive", "Close", "Court", "Crescent"])
    x = f"{n}{r.choice(['', '', 'A'])} {s}"
    return r.choice([x, f"{x}, Apt {n % 60}", f"Flat {n % 60}, {x}", f"{x}, {t}", f"{x}, {t}, QV{n % 30} {n % 9}VX", f"{x}, {t} XJ{n % 30} 1KJ"])


# Carriers: {n} name, {e} email, {p} phone, {i} person_id, {a} address. Fixed values of the training sample: sentences of offices, shops, clinics and schools,
# none of which is taken from the tables that the operator is run on.
CARRIERS = {
    "en": ["Good morning, Mr {n} would like a window seat.", "Tenant {n} ({e}) lost the key to the cellar.", "the folder of Dr {n} lay open at the counter", "Reserved by {n}; ring {p} or write to {e}.", "reserved by '{n}', ring {p} or write to {e}",
           "Please copy {i} for the visa of {n}.", "Loan form, {i}, borrower {n}", "member: {n}; phone: {p}; address: {a}.", "The piano goes from {a} to {a}.", "Two library cards share {e} and {e}.", "A text to {p} never arrived", "Call back on {p} before noon.", "Newsletter for {e} came back.",
           "The notary wants {i} again.", "patient Ms {n} gave the number {p} for emergencies", "guest Mr '{n}' asked for an iron", "login={e} locked", "form filled in by {n} for {n}", "student {n} wants to replace {p} on file", "the sofa belongs at {a}", "{n} rang twice", "The courier found nobody at {a}.",
           "letter from {e} unread", "Mrs {n} moved out of {a} in spring", "Signed: {n}, {i}", "Invitation sent to {n} <{e}>.", "[{n}] checked in at nine", "author {n} wrote to {e}, no reply", "Witness: {n}. Home: {a}. Mobile: {p}.", "ask {n} whether {p} still works", "passenger={n} seat=12A",
           "tell Prof {n} that {e} is full", "buyer {n}, {a}, {p}", "User {n} with {i} stood in line", "contact: {n} / {p} / {e}", "\"{n}\" paid the fine", "phone {p}, mail {e}", "Ship the lamp to {a}, attention {n}.", "coach {n} met {n} and {n} at {a}", "The baker {n} ({p}) is closed", "Singer {n} ({e}) cancelled", "Painter {n} rents {a}", "(call {p})", "Plumber {n} came", "neighbour {n} ({p}, {e})", "(see {e})", "caretaker {n} - {p}"],
    "ru": ["Пришёл читатель {n}, телефон {p}, книгу не нашёл.", "Жилец {n}, почта {e}.", "Жилец «{n}», почта {e}", "Врач: {n}; полис и {i}.", "Заявила г-жа {n}, прописана: {a}.", "Сообщение на {p} не пришло.", "Две карточки, адреса {e} и {p}.", "Для визы нужен {i}, копию приложить",
           "Пианино везут по адресу {a} завтра.", "Переезд с {a} на {a}.", "Рассылка на {e} не доставлена", "Позвонила г-жа {n}", "Ученик {n}, мобильный {p}", "пассажирка {n} потеряла чемодан", "Арендатор г-н {n} ждёт звонка: {p}.", "Свидетель {n}, {i}, проживает {a}", "нотариус {n} принял {i}", "Тренер {n} и врач {n} уехали.",
           "Письмо для {n}: {e}", "контакт {n}, {p}, {e}", "Курьер не нашёл {a}", "Абонент {p} вне сети", "Автор «{n}» прислал рукопись", "Садовник {n} – {p}",
           "Швея {n} звонит", "Повар {n} ({p})", "Бухгалтер {n} в отпуске", "Певица {n} ({e})", "Пекарь {n} видел: {n}", "Художник {n}, {a}", "Сторож {n} спит", "Ветеринар {n} принимает на {a}"],
    "de": ["Mieter Herr {n} sucht den Kellerschlüssel.", "Trainer: {n}; {i}.", "Trainer: „{n}“; {i}", "Bitte um Anruf unter {p}.", "Für das Visum fehlt {i}", "Der Rundbrief an {e} blieb liegen.", "Das Klavier steht noch in {a}.", "Umzug von {a} nach {a}.", "Gast: Frau {n}, {p}, {e}.", "Patientin Frau {n} kommt später",
           "Notar {n} hat unterschrieben", "Wohnt in {a}, Telefon {p}", "Zeugin {n}, {i}, Anschrift {a}", "Autor {n} schrieb an {e}", "Schüler {n} und Schülerin {n} fehlen.", "Mobil {p}, Post {e}", "Das Paket liegt bei {n}, {a}", "Gärtner {n} - {p}", "[{n}] ist angekommen", "Fahrgast {n} ohne Karte",
           "Die Schneiderin {n} ruft an", "der Bäcker {n} ({p})", "Bäckerin {n} hat Urlaub", "unsere Buchhalterin {n} fehlt", "Sängerin {n} ({e})", "Hausmeister {n}: {p}", "Pförtner {n} sah {n}", "Köchin {n} ({p}) kocht", "Tierärztin {n} in {a}", "Maler {n}, {a}"],
}
#: Carriers and decoys of the held-out test: never trained on.
HELD_CARRIERS = {
    "en": ["the flute teacher, {n}, lives at {a}", "Museum ticket for {n} sent to {e}.", "dial {p} after the tone", "We copied {i} at the desk.", "owner of the boat: {n} ({p})", "yesterday {n} forgot an umbrella", "Kindly forward {e} to the printer", "meet me at {a}"],
    "ru": ["Скрипач {n} живёт на {a}", "Билет в музей для {n} ушёл на {e}.", "наберите {p} после сигнала", "Сняли копию: {i}.", "хозяйка лодки: {n} ({p})", "вчера {n} забыл зонт"],
    "de": ["die Flötenlehrerin {n} wohnt in {a}", "Museumskarte für {n} ging an {e}.", "nach dem Ton {p} wählen", "Wir haben {i} kopiert.", "Bootsbesitzer: {n} ({p})", "gestern vergass {n} den Schirm"],
}
NOUNS = ("Gateway Cache Route Table Stand Street Token Broker Order Service Ledger Writer Stock Reader Quota Guard Signal Board Panel Job Retry Loop Pool Keeper Batch Runner Invoice Worker Session Store Search Proxy Access Control Load Balancer Data Center Status Page Plane Grafana "
         "Kafka Topic Redis Cluster Linux Kernel Java Heap Python Monday March June Release Build Version Region North South Team Platform Group Incident Report Payment Billing Queue Thread Socket Bucket Index Shard Replica Leader Follower Node Pod Container Image Registry Pipeline "
         "Stage Deploy Rollback Canary Metric Alert Rule Dashboard Trace Span Request Response Header Cookie Server Client Backend Frontend Database Schema Migration Backup Snapshot Restore Volume Disk Memory Timeout Limit Error Warning Critical Notice Connection Handler Listener Scheduler "
         "Manager Factory Builder Parser Loader Monitor Agent Collector Exporter Partition Offset Consumer Producer Event Message Customer Delivery Shipping Refund Checkout Cart Catalog Profile Account Login Password Certificate Key Secret Vault Zone Host Port Network Firewall Router Switch").split()
PLACES = "Kettle Harrow Lantern Bracken Amber Falcon Willow Copper Juniper Marlow Sable Tundra Vesper Onyx Quartz Zephyr Aurora Nimbus Orion Titan".split()
DECOYS = ["{W} {W} and {W} {W} came back.", "worker lane-{2} left the {W} {W} pool", "{W} Street overview tile {2} shows nothing", "Package {1}.{2}.{5} installed on {W} {W}.", "Ticket-2026-{7} went to state OPEN.", "positions {5}-{5}-{7} stored for shelf ledger", "Carton id {16} is not on the list.",
          "Archive series {7} bound, volumes {1}.", "cloning git@forge-{2}:libs/paint failed", "rsync backup@vault-box-{2} ended in {1} s", "Socket Socket@{8} closed by peer.", "field @version copied to field rev", "box 10.7.{2}.9 gave up lease {5}", "job_{5} moved to machine maple-{2}", "request_id={8}-{4}-{4}-{4}-{12} needed {5} ms",
          "dump of 2026-01-15 03:00:00 read, lines {5}", "due 2026-03-01 00:00:00 passed for task {5}", "store.py:{1} in flush, waiters {5}", "{W} {W} lacks an owner", "time 17{8}.{3} drift {5} ms", "2026-0{1}-1{1} 12:{2}:{2} ERROR {W} {W} gave up", "203.0.113.{2} - - [01/Jan/2025:02:{2}:12 +0100] \"GET /books/{4} HTTP/1.1\" 404 {5}",
          "In {W} {W} the ceiling was {5}", "The fix belongs to the kiln group; more on {W}.", "Трасса кончается в {W}.java:{4}, зовёт {W}.", "На машине kiln-{2} нет места с {W}.", "Erst um 0{1}:{2} bemerkte {W} die leere Liste.", "part {4}-{4} sold, tag {7}", "digest {8}{8} is not equal", "Im Verbund {W} fehlt {W}",
          "Tile {2} {W} Map redrawn", "edition {1}.{2}.{3} print {10}", "{2}.{2}.20{2} 1{1}:{2}:{2} [pool-{1}-thread-{2}] INFO org.kiln.{W} - lease kept for {2} s", "8{2}3#0: *{4} {W} tile {2} is blank", "[{W} {W}] done", "epoch {10} and {13}", "again at 12 March for {W} {W}", "The {W} {W} of kiln-api ended at 10:{2} with {4} in line.",
          "{K} {W} and {K} {W} are healthy", "{K} {W} restarted on {K}", "moved {K} {W} to {W} {W}", "panel {K} {W} shows {2} rows", "{W} {K} is read only", "offset {8} lag {10}", "sha {10}{4} size {9}", "id={8} seq={7} ts={13}", "sum {4}.{2} pieces {7}", "ref {3}-{3}-{4}-{5} parsed", "sku {2}-{4}-{6}", "call {W}.{W} at {W}.java:{3}",
          "took {2}.{3} s, {7} bytes", "port {5} of 10.{2}.{2}.{2}", "retry {1} of {1} after {3} ms", "serial {4} {4} {4} printed", "lot {9} of batch {11}", "booklet {10} shelved", "crate {4}/{2}-{3} sealed", "ids: {7}, {8}, {9}", "checksum={8} crc={10}", "build-{8}-{6} uploaded", "At {W}, {W} took over from {W}.", "{W} and {W}: {W} {W}, {W} {W}"]
HELD_DECOYS = ["the {W} {W} lost its {W}", "crate {9} weighs {3} kg", "{K} {W} runs edition {1}.{2}", "pulled git@attic-{2}:maps/town", "row {7} of {8} at {2}:{2}:{2}", "entry {12} not in the index", "{W} {W} is slow since {W}", "stall {2} Market Map drawn", "10.9.{2}.{2} answered in {3} ms", "span {8}-{4}-{4} of {W}"]
_KIND = {"n": "name", "e": "email", "p": "phone", "i": "person_id", "a": "address"}


def compose(r: random.Random, held: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """One labelled text; `held`: from carriers, decoys and names that training never sees."""
    text, gold = "", []
    carriers, decoys = (HELD_CARRIERS, HELD_DECOYS) if held else (CARRIERS, DECOYS)
    for _ in range(r.choice([1, 1, 2, 3])):
        lang = r.choice(["en", "ru", "de"])
        pattern = r.choice(decoys) if r.random() < 0.5 else r.choice(carriers[lang])
        if pattern[0].isupper() and r.random() < 0.3:
            pattern = pattern[0].lower() + pattern[1:]
        at = 0
        while at < len(pattern):
            c = pattern[at]
            if c == "{":
                key, at = pattern[at + 1:pattern.index("}", at)], pattern.index("}", at) + 1
                if key == "W":
                    text += r.choice(NOUNS)
                elif key == "K":
                    text += r.choice(PLACES)
                elif key.isdigit():
                    text += _d(r, int(key))
                else:
                    kind = _KIND[key]
                    x = email(r) if kind == "email" else name(r, lang, held) if kind == "name" else {"phone": phone, "person_id": person_id, "address": address}[kind](r, lang)
                    gold.append((len(text), len(text) + len(x), kind))
                    text += x
            else:
                text, at = text + c, at + 1
        text += r.choice([". ", " ", "\n", "\n- "]) if not text.endswith(".") else r.choice([" ", "\n"])
    return text.strip(), gold


def lattice(text: str, gold: list, lexicon: pii.Lexicon) -> tuple[list, set[int]]:
    """Candidates in order of their ends, and which of them are gold: of each true segment the candidate of its kind that fits best."""
    cands = sorted(pii.candidates(text, lexicon), key=lambda c: (c[1], c[0]))
    chosen = set()
    for a, b, k in gold:
        fit = [(min(b, y) - max(a, x), -(y - x), n) for n, (x, y, kind, _) in enumerate(cands) if kind == k and min(b, y) - max(a, x) > 0.5 * (b - a)]
        if fit:
            chosen.add(max(fit)[2])
    return cands, chosen


def _log_add(x: float, y: float) -> float:
    return max(x, y) + math.log1p(math.exp(-abs(x - y)))


def marginals(cands: list, scores: list[float]) -> list[float]:
    """Probability of each candidate under the model: forward and backward sums over segment ends."""
    points = sorted({p for a, b, *_ in cands for p in (a, b)})
    place = {p: i for i, p in enumerate(points)}
    ending, starting = defaultdict(list), defaultdict(list)
    for n, (a, b, *_) in enumerate(cands):
        ending[place[b]].append(n)
        starting[place[a]].append(n)
    m = len(points)
    forward, backward = [0.0] * m, [0.0] * m
    for i in range(m):
        x = forward[i - 1] if i else 0.0
        for n in ending[i]:
            x = _log_add(x, forward[place[cands[n][0]]] + scores[n])
        forward[i] = x
    for i in range(m - 1, -1, -1):
        x = backward[i + 1] if i + 1 < m else 0.0
        for n in starting[i]:
            x = _log_add(x, backward[place[cands[n][1]]] + scores[n])
        backward[i] = x
    z = forward[-1] if m else 0.0
    return [math.exp(min(0.0, forward[place[a]] + s + backward[place[b]] - z)) for (a, b, *_), s in zip(cands, scores)]


def train(seed: int = SEED, n: int = N_TEXTS, epochs: int = EPOCHS) -> dict[str, float]:
    r = random.Random(seed)
    lexicon = pii.Lexicon({x for v in GIVEN.values() for x in v if r.random() < KNOWN}, {x for v in FAMILY.values() for x in v if r.random() < KNOWN})
    data, counts = [], Counter()
    for _ in range(n):
        text, gold = compose(r)
        cands, chosen = lattice(text, gold, lexicon)
        cands = [(a, b, k, [k, *(f"{k} {f}" for f in fs)]) for a, b, k, fs in cands]
        for _, _, _, fs in cands:
            counts.update(fs)
        if cands:
            data.append((cands, chosen))
    w: dict[str, float] = defaultdict(float)
    used = {f for f, c in counts.items() if c >= 12}
    data = [([(a, b, k, [f for f in fs if f in used]) for a, b, k, fs in c], g) for c, g in data]
    for epoch in range(epochs):
        r.shuffle(data)
        rate = RATE / (1 + epoch)
        for cands, chosen in data:
            p = marginals(cands, [sum(w[f] for f in fs) for *_, fs in cands])
            for i, (*_, fs) in enumerate(cands):
                step = (i in chosen) - p[i]
                if abs(step) > 1e-4:
                    for f in fs:
                        w[f] += rate * (step - DECAY * w[f])
    # a word by itself may speak against a name, never for one, and an ending only so much against one: names must carry over to others
    w = {f: max(x, LEAST_ENDING) if f.startswith("name end=") else x for f, x in w.items()}
    return {f: round(x, 3) for f, x in sorted(w.items()) if abs(x) > 0.05 and not (" w=" in f and x > 0)}


def evaluate(w: dict[str, float], seed: int = 99, n: int = 1500) -> dict[str, tuple[float, float]]:
    """(precision, recall) by kind on held-out texts: other carriers, decoys and names than trained on; whole segments of equal bounds and kind."""
    r = random.Random(seed)
    lexicon = pii.Lexicon({x for v in GIVEN.values() for x in v if r.random() < KNOWN}, {x for v in FAMILY.values() for x in v if r.random() < KNOWN})
    got, true, both = Counter(), Counter(), Counter()
    for _ in range(n):
        text, gold = compose(r, held=True)
        found = pii.best_segments(text, lexicon, w)
        got.update(k for *_, k in found)
        true.update(k for *_, k in gold)
        both.update(k for *_, k in set(found) & set(gold))
    return {k: (both[k] / max(1, got[k]), both[k] / max(1, true[k])) for k in pii.KINDS}


if __name__ == "__main__":
    model = train()
    Path(pii.__file__).with_name("pii_model.json").write_text(json.dumps(model, ensure_ascii=False, indent=0), encoding="utf-8")
    print(len(model), evaluate(model))
