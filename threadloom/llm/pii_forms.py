"""Invented sentences with personal items, from open vocabularies: what the tagger learns forms and surroundings from.

Names, places, streets and hosts are mostly put together from syllables, so that no list can be learnt by heart; short lists of usual
names and endings add how real ones look. Every maker returns pieces: text, or (text, type) for an item."""

from __future__ import annotations

import numpy as np

Piece = str | tuple[str, str]

# Usual given and family names of several languages, and endings, for the look of real ones.
GIVEN = "Anna Maria James Robert Michael David Mary Linda Susan Karen Thomas Daniel Paul Mark Laura Sarah Julia Hans Jürgen Klaus Sabine Petra Pierre Jean Luc Camille Amélie José Carmen Luis Pablo Lucía Giulia Marco Paolo Sofia Elena Ivan Olga Sergei Natalia Jan Piotr Agnieszka Mei Ling Jun Hiroshi Yuki Kenji Sakura Raj Anita Sanjay Deepa Omar Fatima Ali Layla Kofi Ama Chidi Ngozi Tariq Noor Erik Astrid Lars Freya Niamh Sean Liam Aoife".split()
FAMILY = "Johnson Williams Brown Jones Miller Davis Wilson Taylor Anderson Moore Clark Lewis Walker Hall Young King Wright Green Baker Schmidt Müller Schneider Fischer Weber Becker Wagner Dupont Martin Bernard Laurent García Martínez López Sánchez Rossi Ferrari Bianchi Ivanov Petrov Kowalski Nowak Novák Svensson Hansen Nielsen Okafor Mensah Diallo Khan Patel Singh Sharma Gupta Chen Wang Li Liu Tanaka Suzuki Sato Kim Park Nguyen Tran O'Brien O'Connor MacDonald McKenzie van Dijk de Vries da Silva".split()
ENDINGS = "com org net edu gov io co.uk org.uk ac.uk de fr es it nl eu info biz me us ca com.au co.nz ch at be se no dk pl pt ie in jp com.br example invalid test".split()
HOSTS = "gmail googlemail outlook hotmail yahoo icloud proton gmx web mail post inbox".split()
TITLES = "Mr Mrs Ms Miss Dr Prof Professor Doctor Frau Herr Madame Mme Sir".split()
STREETS = "Street Road Lane Avenue Drive Close Court Way Place Terrace Gardens Square Crescent Grove Hill Row Rise Quay Walk Park Boulevard Parkway St Rd Ave Blvd Ln".split()
SYLLABLES = "ba ber bru cal dar del dun eck fal fen gar gor hal han is jor kel kin lan lar mar mel mo nar nel ol or pet quin ran ros sal sten tar tho um val ver wes wyn yar zel ak shi mu no ra ta ki bo chi ad eze ife oto sun jin hao min".split()
WORDS = "silver oak river stone happy green lucky cloud night garden coffee pixel copper raven maple tiger sunny bike music chess winter blue fox moon lake tea book star paper jazz forest pepper hill snow".split()

NAME_IN = ["My name is {}.", "Yesterday I met {} at the station.", "{} will bring the keys.", "Thanks to {} for the help.", "please ask {} about it", "I spoke with {} on the phone.", "Regards, {}", "Best,\n{}", "Signed: {}", "It was {} who told me.", "Say hello to {}!", "Invoice for {}", "{} wrote the report last year", "According to {}, it works.", "The parcel is addressed to {}.", "Attn: {}", "Either {} or {} will open the door.", "{} lives next door.", "I'm {}, nice to meet you all.", "Contact {} for details", "my boss {} said no", "Has anyone seen {} lately?", "I met {} and {} in {P}.", "The director was {}.", "{} called twice.", "{} sent the file.", "{}, who runs the shop, agreed.", "Her name is {} and his is {}.", "We asked {} and {}, both said yes.", "Talk to {} or to {} first.", "{} and {} are away until Monday.", "the singer {} was there", "In 1998 {} moved to {P}.", "It was written by {}.", "{}: thanks!", "{}"]
EMAIL_IN = ["Write to {} please.", "My address is {}", "mail {} for a copy", "Contact: {}", "you can reach me at {}.", "Send it to {} or {}.", "E-mail: {}", "({})", "<{}>", "Questions? {}", "reply off-list, {}", "I used {} to sign up, no answer yet.", "forward everything to {} by Monday", "{} bounced."]
PHONE_IN = ["Call me on {}.", "Tel. {}", "phone: {}", "My number is {}, after six.", "ring {} and ask for the yard", "Mobile {} or {}", "WhatsApp works too: {}", "text {} if you are late", "You can call {} any time.", "Fax {}", "({})", "the office is on {}"]
ID_IN = ["My SSN is {}.", "social security number {}", "passport {} expires soon", "Passport no. {}", "I lost my ID card, number {}.", "driving licence {}", "driver's license number: {}", "NI number {}", "National insurance: {}", "They asked for my passport number, {}, twice.", "identity card no. {}", "The form has {} as my social security no.", "Personalausweis {}"]
ADDRESS_IN = ["I live at {}.", "Send it to {}", "Our new address is {}", "She moved to {} last spring.", "Deliver to {} please", "Address: {}", "Pick it up at {}.", "we are at {}, second floor", "The house at {} is for sale.", "Post it to {}"]
PLAIN = ["Order number {n8} has not arrived.", "Version {v} fixed it.", "ISBN {isbn} is out of print.", "The score was {d}-{d} at half time.", "Meet at {h}:{mm} by the {w} {w}.", "It cost {n3} euros and {n2} cents.", "Serial {s} needs an update.", "see https://{h1}.example.com/{w}/{n4} for a photo", "The {T} is closed on Mondays.", "Thanks @{u}, that helps.", "{u} posted the same thing.", "Room {n2}, floor {d}, ask at the desk.", "On {d} {month} {y} it rained all day.", "We drove from {P} to {P} in {d} hours.", "Platform {d} at {h}:{mm}, then change.", "Add {n3} ml of water and {n2} g of salt.", "The {w} street market opens at {h}.", "I run {d} km every day.", "error code {hex} again", "Tracking {s2} says delivered.", "as {u} wrote above", "The road to {P} is shut.", "Chapter {d}, page {n3}.", "{P} beat {P} {d}:{d}.", "My car is a {y} model, {n5} miles.", "VAT {n3} percent? no way.", "Model {s} beats model {s}.", "The bus {n2} stops at the {T}.", "Thanks {W} {W} ban, that helps.", "Ping {W} {W}ban.", "As {W} {W} ban wrote above.", "Ignore {W} {w}, just try it.", "cc {W}{w}ban", "I am with {W} {W}ban on that.", "go to hell, {w}"]
MONTHS = "January February March April May June July August September October November December".split()


class Maker:
    def __init__(self, rng: np.random.Generator) -> None:
        self.rng = rng

    def one(self, of) -> str:
        return of[int(self.rng.integers(len(of)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def digits(self, n: int) -> str:
        return "".join(str(d) for d in self.rng.integers(0, 10, n))

    def letters(self, n: int) -> str:
        return "".join(chr(65 + c) for c in self.rng.integers(0, 26, n))

    def coined(self, least: int = 2, most: int = 3) -> str:
        return "".join(self.one(SYLLABLES) for _ in range(self.rng.integers(least, most + 1))).capitalize()

    def given(self) -> str:
        return self.one(GIVEN) if self.chance(0.6) else self.coined(1, 3)

    def family(self) -> str:
        f = self.one(FAMILY) if self.chance(0.55) else self.coined(2, 3)
        if self.chance(0.06):
            f = f"{f}-{self.coined(2, 2)}"
        if self.chance(0.05):
            f = self.one(("O'", "Mc", "Mac", "d'", "de ", "van ", "von ", "al-")) + f
        return f + self.one(("son", "man", "ton", "well", "field", "ski", "ova", "ez", "mann", "berg")) if self.chance(0.15) else f

    def name(self) -> str:
        g, f, t = self.given(), self.family(), self.one(TITLES) + ("." if self.chance(0.5) else "")
        middle = f" {self.letters(1)}." if self.chance(0.12) else f" {self.given()}" if self.chance(0.04) else ""
        out = self.one((f"{g}{middle} {f}",) * 9 + (f"{f}, {g}",) * 2 + (f"{t} {f}",) * 2 + (f"{t} {g} {f}",))
        r = self.rng.random()
        return out.lower() if r < 0.12 else out.upper() if r < 0.2 else out

    def email(self) -> str:
        g, f = self.given().lower(), self.family().lower().replace(" ", "").replace("'", "")
        w, n = self.one(WORDS), self.digits(int(self.rng.integers(1, 5)))
        local = self.one((f"{g}.{f}", f"{g}_{f}{n}", f"{g[0]}{f}", f"{g}{n}", f"{w}{self.one(WORDS)}{n}", f"{w}.{n}", f"{g}-{f}", f"{w}+{self.one(WORDS)}", f"{f}{g[0]}", self.one(("info", "sales", "contact", "office", "support", "hello", "admin"))))
        host = self.one((self.one(HOSTS), self.one(WORDS) + self.one(WORDS), self.coined().lower(), f"{self.coined().lower()}-{self.one(WORDS)}", f"{self.one(HOSTS)}.{self.coined().lower()}", self.one(("acme", "corpmail", "uni", "bank"))))
        at, dot = self.one((("@", "."),) * 14 + (("[at]", "[dot]"), (" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), ("&#64;", "."), (" @ ", "."), ("(at)", "(dot)")))
        out = f"{local}{at}{host}.{self.one(ENDINGS)}"
        out = out if dot == "." else local.replace(".", dot if self.chance(0.3) else ".") + at + f"{host}.{self.one(ENDINGS)}".replace(".", dot)
        return out.upper() if self.chance(0.04) else out

    def phone(self) -> str:
        d, s = self.digits, self.one((" ", "-", ".", "", " - ", "/"))
        k = str(self.rng.integers(2, 10))
        shapes = [f"+{self.rng.integers(1, 99)} {k}{d(2)} {d(3)} {d(3)}", f"+1 ({k}{d(2)}) {d(3)}-{d(4)}", f"({k}{d(2)}) {d(3)}-{d(4)}", f"{k}{d(2)}{s or '-'}{d(3)}{s or '-'}{d(4)}", f"0{k}{d(2)}{s}{d(3)}{s}{d(4)}", f"07{d(3)} {d(6)}", f"+44 7{d(3)} {d(6)}", f"+44 (0)20 {d(4)} {d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"+49 {d(3)} {d(7)}", f"+33 {k} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{k}{s}{d(2)}{s}{d(2)}{s}{d(2)}{s}{d(2)}", f"00{self.rng.integers(30, 50)} {d(3)} {d(6)}", f"+{self.rng.integers(1, 99)}{d(10)}", f"0{k}{d(2)}/{d(6)}"]
        words = "zero one two three four five six seven eight nine".split()
        if self.chance(0.03):
            return " ".join(words[int(c)] for c in d(int(self.rng.integers(8, 12))))
        return self.one(shapes)

    def identity(self) -> str:
        d, a = self.digits, self.letters
        return self.one((f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{a(2)} {d(2)} {d(2)} {d(2)} {a(1)}", f"{a(2)}{d(6)}{a(1)}", f"{a(1)}{d(8)}", f"{d(9)}", f"{a(2)}{d(7)}", f"{a(1)}{d(7)}", f"{a(5)}{d(6)}{a(1)}{d(1)}{a(2)}", f"{a(1)}{d(3)}-{d(4)}-{d(4)}", f"{d(8)}{a(1)}", f"{a(1)}{d(2)}{a(2)}{d(5)}", f"{a(2)}-{d(6)}-{d(1)}", f"{d(3)} {d(6)}"))

    def place(self) -> str:
        return self.coined(2, 3) + self.one(("", "", "ton", "ford", "burg", "ville", "dorf", " Cross", " Bay"))

    def address(self) -> str:
        n = str(self.rng.integers(1, 400)) + (self.one("ABCabc") if self.chance(0.15) else "")
        name = self.coined(2, 3) if self.chance(0.6) else self.one(WORDS + ["church", "station", "mill", "high", "main", "elm", "queen", "bridge", "market"]).capitalize()
        street = f"{name} {self.one(STREETS)}"
        german = f"{name}{self.one(('straße', 'strasse', 'weg', 'gasse', 'allee', 'platz', 'str.'))} {n}"
        french = f"{n}{self.one(('', ',', ' bis'))} {self.one(('rue', 'avenue', 'boulevard', 'place', 'chemin'))} {self.one(('de ', 'du ', 'des ', 'de la ', ''))}{name}"
        line = self.one((f"{n} {street}",) * 5 + (german,) * 2 + (french,) * 2 + (f"no. {n}, {street}", f"Flat {self.rng.integers(1, 40)}, {n} {street}", f"{n} {street}, Apt {self.rng.integers(1, 90)}", f"Calle {name} {n}", f"Via {name} {n}"))
        if self.chance(0.5):
            code = self.one((f"{self.digits(5)}", f"{self.letters(2)}{self.rng.integers(1, 30)} {self.rng.integers(1, 9)}{self.letters(2)}"))
            town = self.place()
            line += self.one((f", {town}", f", {code} {town}", f", {town} {code}", f"\n{town}\n{code}", f"\n{code} {town}", f", {town}, {self.letters(2)} {self.digits(5)}"))
        r = self.rng.random()
        return line.lower() if r < 0.06 else line.upper() if r < 0.1 else line

    def plain(self) -> str:
        rng = self.rng
        user = self.one((f"{self.one(WORDS)}_{self.one(WORDS)}", f"{self.one(WORDS)}{self.one(WORDS)}{rng.integers(1, 99)}", f"{self.one(WORDS).capitalize()}{self.one(WORDS).capitalize()}"))
        values = {"n2": self.digits(2), "n3": self.digits(3), "n4": self.digits(4), "n5": self.digits(5), "n8": self.digits(int(rng.integers(6, 12))), "v": f"{rng.integers(1, 20)}.{rng.integers(0, 30)}.{rng.integers(0, 99)}", "isbn": f"978-{self.digits(1)}-{self.digits(2)}-{self.digits(6)}-{self.digits(1)}", "d": str(rng.integers(1, 30)), "h": str(rng.integers(1, 24)), "mm": f"{rng.integers(0, 60):02d}", "w": self.one(WORDS), "W": self.one(WORDS).capitalize(), "s": f"{self.letters(2)}-{self.digits(5)}", "s2": f"{self.letters(2)}{self.digits(9)}{self.letters(2)}", "h1": self.one(WORDS), "T": f"{self.one(WORDS).capitalize()} {self.one(('Hall', 'Inn', 'Café', 'Market', 'Museum', 'Library'))}", "u": user, "month": self.one(MONTHS), "y": str(rng.integers(1950, 2026)), "P": self.place(), "hex": f"0x{self.digits(4)}{self.letters(1)}"}
        out = self.one(PLAIN)
        for k, v in values.items():
            out = out.replace("{" + k + "}", v)
        return out

    def sentence(self) -> list[Piece]:
        kind, frames, item = self.one((*[("name", NAME_IN, self.name)] * 5, ("email", EMAIL_IN, self.email), ("phone", PHONE_IN, self.phone), ("id_number", ID_IN, self.identity), ("address", ADDRESS_IN, self.address)))
        parts = self.one(frames).replace("{P}", self.place()).split("{}")
        out: list[Piece] = [parts[0]]
        for p in parts[1:]:
            out += [(item(), kind), p]
        return out

    def text(self, around: str) -> tuple[str, list[tuple[int, int, str]]]:
        """Invented sentences, among words of a forum text that holds no item; with the places of the items."""
        at = around.find(". ") + 2 if ". " in around else 0
        pieces: list[Piece] = [around[:at]] if self.chance(0.6) else []
        for _ in range(int(self.rng.integers(1, 4))):
            pieces += [*self.sentence(), " "] if self.chance(0.65) else [self.plain(), " "]
        pieces += [around[at:]] if self.chance(0.5) else []
        out, marks = "", []
        for p in pieces:
            if isinstance(p, tuple):
                marks.append((len(out), len(out) + len(p[0]), p[1]))
                p = p[0]
            out += p
        return out, marks
