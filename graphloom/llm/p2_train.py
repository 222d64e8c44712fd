"""Training the tagger: labelled spans, gradients and Adam, in numpy.

    python -m graphloom.llm.p2_train BACKGROUND.parquet [STEPS] [PROCESSES]

Labelled texts are made by setting generated personal items, with their labels,
into generated sentences between lines of a bounded sample (``SAMPLE`` rows) of
texts.  Names, streets, towns and hosts come from public inventories of common
ones and, half of the time, from random syllables, so the tagger learns forms and
surroundings, not a list.  The background is what is left of the sample without
the texts in which the weights at hand find an item; without weights, a first
short training on generated sentences alone gives them.  Each process makes its own
examples; their gradients are averaged in every step.  The fitted weights are
written to p2_weights.npz beside this file.
"""

from __future__ import annotations

import multiprocessing
import random
import re
import sys
import time
from pathlib import Path

import numpy as np

from graphloom.llm.p2_model import KINDS, N, PAD, TRAINED, Tagger, codes

SAMPLE = 12_000
HIDDEN = 48

#: Common first names, family names, towns and street words of several countries.
FIRST = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Donald Steven Paul Andrew Joshua Kenneth Kevin Brian George Edward Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Betty Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Melissa Deborah Olivia Emma Grace Chloe Liam Noah Oliver "
    "Hans Peter Klaus Jürgen Wolfgang Uwe Dieter Sabine Petra Monika Ursula Renate Heike Katrin Lukas Leon Finn Jonas Lena Mia Hannah Günther Jean Pierre Michel Philippe Alain Nicolas François Marie Nathalie Isabelle Sylvie Catherine Camille Chloé Léa Hugo Louis Zoé André Antonio José Manuel Francisco Juan Javier Carlos Miguel Carmen Josefa Isabel Dolores Pilar Lucía Sofía Martín Íñigo "
    "Giovanni Giuseppe Marco Paolo Giulia Francesca Piotr Jan Agnieszka Katarzyna Ivan Dmitri Olga Natalia Sven Lars Ingrid Astrid Mehmet Ayşe Fatma Ahmed Mohammed Omar Fatima Aisha Raj Amit Priya Anjali Sanjay Wei Li Ming Hiroshi Yuki Kenji Sakura Kofi Ama Chinedu Ngozi Barack Ada Tom Ben Sam Max Eva Nora Kim"
).split()
LAST = (
    "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Thomas Moore Jackson Martin Lee Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Hill Green Adams Nelson Baker Hall Campbell Mitchell Carter Roberts Obama Evans Turner Parker Collins Edwards Stewart Morris Murphy Cook Rogers "
    "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Schäfer Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Braun Krüger Hartmann Lange Werner Krause Lehmann Köhler Maier Dupont Bernard Dubois Petit Durand Leroy Moreau Simon Laurent Lefebvre Michel Garcia Roux Fournier Girard Bonnet Lambert Fontaine Rousseau Vincent Faure Mercier "
    "González Rodríguez Fernández López Martínez Sánchez Pérez Gómez Martín Jiménez Ruiz Hernández Díaz Moreno Álvarez Romero Alonso Gutiérrez Navarro Torres Rossi Russo Ferrari Esposito Bianchi Romano Kowalski Nowak Wiśniewski Ivanov Petrov Andersson Johansson Hansen Larsen Nielsen Yılmaz Kaya Demir Khan Hussein Kumar Singh Sharma Patel Gupta Chen Wang Zhang Nguyen Tanaka Suzuki Sato Mensah Okafor O'Brien McDonald"
).split()
TOWN = "London Manchester Bristol Leeds Oxford York Boston Chicago Seattle Denver Austin Portland Washington Springfield Toronto Dublin Berlin Hamburg München Köln Frankfurt Stuttgart Leipzig Dresden Bremen Wien Graz Zürich Bern Paris Lyon Marseille Toulouse Nantes Lille Rennes Bordeaux Genève Madrid Barcelona Valencia Sevilla Zaragoza Bilbao Granada Murcia Roma Milano Warszawa Praha Oslo Amsterdam Utrecht".split()
STREET = "Oak Maple Cedar Pine Elm Park Lake Hill Main Washington Lincoln Jefferson Pennsylvania Sunset Victoria Albert Queens Kings Abbey Baker Downing Fleet Mill Bridge Castle Market School Station Garden Meadow Spring Valley Orchard Chestnut Walnut Willow Birch Highland Franklin Madison".split()
STRASSE = "Haupt Bahnhof Garten Schul Dorf Berg Kirch Wald Ring Linden Birken Goethe Schiller Mozart Post Markt Mühlen Rosen Feld Wiesen Friedrich Bismarck Beethoven Eichen Tal".split()
RUE = "de la Paix|de la République|Victor Hugo|du Moulin|des Lilas|de l'Église|Pasteur|Jean Jaurès|du Château|des Écoles|de la Gare|Voltaire|des Fleurs|Saint-Michel|du Port|de Verdun|des Champs|de Lorraine".split("|")
CALLE = "Mayor|Real|de Alcalá|del Sol|San Juan|de la Iglesia|Goya|Cervantes|de la Paz|Nueva|del Carmen|Santa María|Colón|Velázquez|de Toledo|La Fuente|del Prado".split("|")


def syllables(r: random.Random, least: int = 2, most: int = 3) -> str:
    """An invented word."""
    on = r.choice(["b", "br", "c", "ch", "cl", "d", "dr", "f", "fr", "g", "gr", "h", "j", "k", "kr", "l", "m", "n", "p", "qu", "r", "s", "sh", "st", "str", "t", "th", "tr", "v", "w", "y", "z", "", ""])
    out = on
    for i in range(r.randint(least, most)):
        out += r.choice(["a", "e", "i", "o", "u", "ae", "ei", "ou", "ie", "y", "ö", "é", "ia"] if r.random() < 0.3 else "aeiou")
        out += r.choice(["l", "n", "r", "s", "t", "d", "m", "ck", "nd", "rn", "st", "ll", "rk", "ld", "v", "b", "g", "lm", "nn", "sh", "", ""])
    return out


def place(r: random.Random) -> str:
    x = r.random()
    if x < 0.45:
        return r.choice(TOWN)
    out = syllables(r).capitalize() + r.choice(["", "", "ton", "ford", "ham", "burg", "dorf", "hausen", "heim", "mere", "au", "ville", "bach", "wick", "by"])
    if r.random() < 0.12:
        out = r.choice(["Saint-", "Bad ", "San ", "New ", "Villa", "Santa "]) + out
    return out


def _digits(r: random.Random, form: str) -> str:
    return "".join(str(r.randrange(10)) if c == "0" else r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") if c == "A" else c for c in form)


def first(r: random.Random) -> str:
    f = r.choice(FIRST) if r.random() < 0.6 else syllables(r, 1, 2).capitalize() + r.choice(["", "a", "o", "in", "el", "us", "e"])
    return f"{f}-{r.choice(FIRST)}" if r.random() < 0.03 else f


def surname(r: random.Random) -> str:
    x = r.random()
    if x < 0.4:
        out = r.choice(LAST)
    elif x < 0.75:
        out = syllables(r, 1, 2).capitalize() + r.choice("son man mann berg stein ley ton wood field worth er sen ski ova ini elli ez es ard eau ström quist vic enko dottir land haus bauer feld bach ham shaw hurst gard escu opoulos".split())
    elif x < 0.95:
        out = syllables(r).capitalize()
    else:
        out = r.choice(["Mc", "Mac", "O'", "De", "Di"]) + syllables(r).capitalize()
    return f"{out}-{r.choice(LAST)}" if r.random() < 0.04 else out


TITLES = ["Dr.", "Dr", "Prof.", "Professor", "Prof. Dr.", "Mr", "Mr.", "Mrs", "Mrs.", "Ms", "Ms.", "Mx", "Mx.", "Miss", "Sir", "Frau", "Herr", "Fräulein", "Mme", "Mlle", "M.", "Madame", "Monsieur", "Sr.", "Sra.", "Srta.", "Señor", "Señora", "Don", "Doña", "Doktor"]


def name(r: random.Random) -> str:
    f, s = first(r), surname(r)
    x = r.random()
    if x < 0.26:
        out = f"{f} {s}"
    elif x < 0.36:
        out = f"{s}, {f}" if r.random() < 0.75 else f"{s}, {f[0]}."
    elif x < 0.52:
        out = f"{r.choice(TITLES)} {s}"
    elif x < 0.6:
        out = f"{r.choice(TITLES)} {f} {s}"
    elif x < 0.73:
        out = f"{f[0]}. {s}" if r.random() < 0.85 else f"{f[0]}. {r.choice('ABCDEFGHJKLMNPRST')}. {s}"
    elif x < 0.84:
        out = f"{f} {r.choice('ABCDEFGHJKLMNPRSTW')}. {s}"
    elif x < 0.95:
        out = f"{f} {r.choice(['van der', 'van der', 'van den', 'von', 'von der', 'de', 'de la', 'van', 'al', 'del', 'da', 'di', 'du', 'ten', 'bin', 'zu'])} {s}"
    else:
        out = f"{f} {first(r)} {s}"
    y = r.random()
    return f"{out[: -len(s)]}{s.upper()}" if y < 0.08 and out.endswith(s) else out.upper() if y < 0.09 else out


def plain_letters(s: str) -> str:
    import unicodedata

    return re.sub(r"[^a-z]", "", unicodedata.normalize("NFKD", s.lower().replace("ß", "ss").replace("ı", "i")))


def host(r: random.Random) -> str:
    x = r.random()
    if x < 0.15:
        return r.choice(["gmail.com", "outlook.com", "yahoo.com", "web.de", "orange.fr", "hotmail.es", "proton.me", "icloud.com"])
    word = lambda: plain_letters(syllables(r)) or "mail"
    base = word() if x < 0.6 else f"{word()}-{word()}" if x < 0.72 else r.choice(["mail", "post", "uni", "team", "office", "dept"]) + r.choice(["", "-", "."]) + word()
    return base + r.choice([".com", ".org", ".net", ".de", ".fr", ".es", ".io", ".co.uk", ".edu", ".example", ".test", ".invalid", ".example.com", ".example.org", ".eu", ".info"])


def email(r: random.Random) -> str:
    f, s = plain_letters(first(r)) or "a", plain_letters(surname(r)) or "b"
    user = r.choice([f"{f}.{s}", f"{f}_{s}", f"{s}_{f}", f"{s}.{f}", f"{s}-{f[0]}", f"{f[0]}{s}", f"{f[0]}.{s}", f"{f}{s}", f"{s}{f[0]}", f, s, f"{f}{r.randrange(1, 9999)}", f"{f}.{s}{r.randrange(99)}", f"{f}.{s}+{plain_letters(syllables(r, 1, 2))}", r.choice(["info", "office", "sales", "billing", "kontakt", "hr"])])
    h = host(r)
    x = r.random()
    if x < 0.6:
        out = f"{user}@{h}"
    elif x < 0.68:
        out = f"{user} @ {h}"
    elif x < 0.76:
        out = user + r.choice(["[at]", " [at] ", "(at)", " (at) "]) + h
    elif x < 0.86:
        out = f"{user}{r.choice([' (at) ', ' [at] '])}{h.replace('.', r.choice([' (dot) ', ' [dot] ', ' . ']))}"
    elif x < 0.91:
        out = f"{user} at {h.replace('.', ' dot ')}"
    else:
        out = f"mailto:{user}@{h}"
    return out.upper() if r.random() < 0.1 else out


def phone(r: random.Random) -> str:
    """A number of one of the usual national or international groupings."""
    group = lambda *n: [_digits(r, "0" * k) for k in n]
    x = r.random()
    sep = r.choice([" ", "-", ".", "/", "\u2011", "\u00a0"]) if r.random() < 0.75 else " "
    if x < 0.34:  # three, three and four digits
        a, b, c = group(3, 3, 4)
        out = r.choice([f"{a}{sep}{b}{sep}{c}", f"({a}) {b}{r.choice([' ', '-'])}{c}", f"+1 ({a}) {b}-{c}", f"+1{sep}{a}{sep}{b}{sep}{c}", f"1{sep}{a}{sep}{b}{sep}{c}", f"001 {a} {b} {c}", f"+1{a}{b}{c}", f"{a}{sep}{b}{sep}{c}"])
    elif x < 0.6:  # a national prefix 0 and one to three groups
        a = "0" + _digits(r, "0" * r.randint(1, 4))
        out = a + r.choice([" ", "/", "-", " / "]) + r.choice([" ", "", "-"]).join(group(*[r.randint(2, 4) for _ in range(r.randint(2, 3))]))
    elif x < 0.85:  # international
        cc = r.choice(["+44", "+33", "+49", "+34", "+39", "+41", "+43", "+31", "+48", "+91", "+81", "0044", "0049", "+351", "+90"])
        out = f"{cc}{r.choice([' ', '', '-', ' (0)'])}{sep.join(group(*[r.randint(1, 4)] + [r.randint(2, 4) for _ in range(r.randint(2, 3))]))}"
    elif x < 0.93:  # pairs
        out = sep.join(["0" + _digits(r, "0")] + group(2, 2, 2, 2))
    else:
        out = " ".join(group(r.choice([2, 3]), 3, 2, r.choice([2, 3])))
    return out + r.choice([f" ext. {r.randrange(10, 9999)}", f" x{r.randrange(10, 999)}", f" ext {r.randrange(10, 999)}", f" Durchwahl {r.randrange(10, 99)}"]) if r.random() < 0.07 else out


#: What identity numbers are called.
PAPERS = ["NI number", "NI number", "NI no.", "passport", "Passport", "passport no.", "passport number", "Passport No", "Reisepass", "Reisepassnummer", "Pass-Nr.", "passeport", "passeport n°", "pasaporte", "Personalausweis", "Personalausweisnr.", "Ausweis", "Ausweisnr.", "Ausweisnummer", "ID card", "ID card no.", "identity card number", "national ID", "national identity number", "carte d'identité", "CNI", "DNI", "NIE", "NIF", "cédula", "SSN", "SSN:", "social security number", "social security no.", "Social Security", "Soc. Sec. No.", "Sozialversicherungsnummer", "SV-Nummer", "numéro de sécurité sociale", "n° de sécu", "INSEE", "NSS", "número de la seguridad social", "NI number", "National Insurance number", "NINO", "tax ID", "tax number", "TIN", "Steuer-ID", "Steuernummer", "Steueridentifikationsnummer", "numéro fiscal", "número fiscal", "insurance number", "insurance no.", "Versicherungsnummer", "policy holder number", "driving licence", "driving licence no.", "driver's license", "driver license number", "Führerschein", "Führerscheinnr.", "permis de conduire", "permiso de conducir", "licence number", "licence no."]
SHAPES = ["AA 00 00 00 A", "AA 00 00 00 A", "000-00-0000", "000 00 0000", "000000000", "00 000 000 000", "00000000000", "A0000000", "AA0000000", "A00000000", "AA000000", "00AA00000", "AA 00 00 00 A", "AA000000A", "A00AA0000", "A0AA00A00", "00000000A", "00000000-A", "A0000000A", "A-0000000-A", "0000-0000-A", "0000-0000", "0 00 00 00 000 000 00", "000000000000000", "00/000/00000", "000/0000/0000", "00 000000 A 000", "00000000A000", "AAAAA000000AA", "AAAAA000000AA0AA", "AAAA 000000 0AA", "A000-0000-0000", "000000000000", "AA-000000", "000.000.000-00", "000-000-000", "AAA000000"]


def identity(r: random.Random) -> str:
    number = _digits(r, r.choice(SHAPES))
    if r.random() < 0.35:  # a shape nobody listed
        number = _digits(r, "".join(r.choice(["00", "000", "0", "0000", "A", "-", " ", "/", ""] if i else ["000", "A00", "00"]) for i in range(r.randint(3, 5))).strip(" -/") + "0")
    return r.choice(PAPERS) + r.choice([" ", " ", " ", ": ", " # ", " no. ", " nr. "]) + number


KINDS_OF_STREET = ["Street", "St.", "St", "Avenue", "Ave", "Ave.", "Road", "Rd.", "Rd", "Lane", "Ln", "Close", "Terrace", "Boulevard", "Blvd", "Way", "Drive", "Dr.", "Court", "Ct", "Place", "Pl.", "Crescent", "Square", "Row", "Gardens", "Grove", "Hill", "Walk", "Parade"]


def address(r: random.Random) -> str:
    n = r.randint(1, 30) if r.random() < 0.3 else r.randint(1, 299) if r.random() < 0.8 else r.randint(300, 9999)
    s = r.choice(STREET) if r.random() < 0.5 else syllables(r).capitalize() + r.choice(["", "", "gate", "field", "brook", "bank", "berry", "wood"])
    t, code = place(r), _digits(r, "00000")
    x = r.random()
    if x < 0.45:
        kind = r.choice(KINDS_OF_STREET)
        number = f"{n}{r.choice('ABCDabc')}" if r.random() < 0.1 else f"{n}"
        way = f"{r.choice(['N.', 'S.', 'E.', 'W.', 'North', 'West', 'Old', 'Upper'])} " if r.random() < 0.1 else ""
        out = f"{number} {way}{s} {kind}" + (f" {r.choice(['NW', 'SE', 'N', 'W'])}" if r.random() < 0.05 else "")
        if r.random() < 0.15:
            out = f"{r.choice(['Flat', 'Apt', 'Apartment', 'Suite', 'Unit'])} {r.randint(1, 40)}{r.choice(['', '', 'A', 'B'])}, {out}"
        elif r.random() < 0.18:
            out += f"{r.choice([', ', ' '])}{r.choice(['Apt', 'Apt.', 'Suite', 'Unit', 'Floor', '#', 'Ste'])} {r.randint(1, 40)}"
        y = r.random()
        if y < 0.3:
            out += f", {t}"
        elif y < 0.42:
            out += f", {t} {code}"
        elif y < 0.5:
            out += f", {t}, {r.choice(['NY', 'CA', 'TX', 'MA', 'IL', 'WA', 'DC', 'OR'])} {code}"
        elif y < 0.56:
            out += f", {t} {_digits(r, r.choice(['AA0 0AA', 'A00 0AA', 'AA00 0AA']))}"
    elif x < 0.68:
        stem = r.choice(STRASSE) if r.random() < 0.6 else syllables(r).capitalize()
        street = stem + r.choice(["straße", "strasse", "str.", "weg", "gasse", "allee", "platz", "ring", "damm", "ufer"])
        if r.random() < 0.12:
            street = f"{r.choice(['Am', 'An der', 'Im', 'Zum', 'Unter den'])} {stem}{r.choice(['weg', 'berg', 'tor', 'bach', ''])}"
        number = r.choice([f"{n}", f"{n}", f"{n}{r.choice('abcd')}", f"{n}/{r.randint(1, 30)}", f"{n}-{n + 2}"])
        out = f"{street} {number}" + (f", {code} {t}" if r.random() < 0.35 else f", {t}" if r.random() < 0.4 else "")
    elif x < 0.85:
        kind = r.choice(["rue", "rue", "rue", "avenue", "boulevard", "chemin", "place", "allée", "quai", "impasse"])
        street = r.choice(RUE) if r.random() < 0.6 else r.choice(["du ", "de la ", "des ", "de ", ""]) + syllables(r).capitalize() + r.choice(["", "s"])
        out = f"{n}{r.choice(['', '', ' bis', ' ter'])}{r.choice([' ', ', '])}{kind} {street}" + (f", {code} {t}" if r.random() < 0.45 else f", {t}" if r.random() < 0.5 else "")
    else:
        street = r.choice(CALLE) if r.random() < 0.5 else syllables(r).capitalize()
        out = f"{r.choice(['Calle', 'Calle', 'C/', 'Avenida', 'Avda.', 'Plaza', 'Paseo', 'Via', 'Camino'])} {street}{r.choice([' ', ', '])}{n}"
        if r.random() < 0.4:
            out += f", {r.randint(1, 9)}º{r.choice([' A', ' B', ' C', ' izq.', ' dcha.', ''])}"
        if r.random() < 0.5:
            out += f", {code + ' ' if r.random() < 0.4 else ''}{t}"
    return out.upper() if r.random() < 0.05 else out


MAKE = {"NAME": name, "EMAIL": email, "PHONE": phone, "ID_NUMBER": identity, "ADDRESS": address}
#: Sentences around an item are put together from these: what comes before, by kind and language, and what comes after.
BEFORE = {
    "NAME": "I talked to|We asked|Yesterday|The meeting was led by|Please call|Thanks to|thank you|Dear|Hello|Hi|Hey|written by|author:|contact:|signed:|from|sent by|My name is|This is|Ask for|The customer|Patient|Applicant|The tenant,|our colleague|her boss|together with|approved by|requested by|handled by|as told by|as|according to|says|President|Ich sprach mit|Danke an|Sehr geehrte|Hallo|Liebe|Termin mit|Ansprechpartner:|erfasst von|genehmigt durch|laut|von|Gruß von|J'ai parlé à|Merci à|Bonjour|Cher|Chère|écrit par|selon|demandé par|Hablé con|Gracias a|Hola|Estimada|según|escrito por|firmado por|preguntó|pidió||||".split("|"),
    "EMAIL": "Send it to|My address is|You can reach me at|mail me:|e-mail|Email:|E-Mail:|contact|cc:|bcc|To:|From:|Reply-To:|forwarded from|the sender was|ask|Schreib an|per Mail an|Antwort an|erreichbar unter|Envoyer à|écrire à|courriel :|répondre à|Escriba a|correo:|enviar a|contesta a||||".split("|"),
    "PHONE": "Call me at|call|phone|Phone:|Tel.|tel:|Telephone number|mobile|cell:|my number is|dial|fax|WhatsApp|SMS to|text|reach us on|hotline|ring|Telefon|Tel.:|Handy|ruf an unter|erreichbar unter|Fax:|Tél. :|téléphone|appelez le|appeler au|portable|teléfono|tel.|móvil|llame al|llamar|contacto:||||".split("|"),
    "ID_NUMBER": "My|The|with|her|his|the document says|on the form:|valid|we scanned|expired|please verify|checked|number given:|I lost my|copy of|mit|laut|gültig:|Nummer:|vorgelegt wurde|avec|présenté :|voici mon|con|según|presentó|documento||||".split("|"),
    "ADDRESS": "I live at|We moved to|ship it to|send the box to|address:|Address:|home address|located at|the office at|visit us at|deliver|billing address|stay at|meet me at|born at|fire at|Ich wohne|wohnhaft|Adresse:|geliefert an|Lieferadresse|Sitz:|in der|J'habite|adresse :|livrer au|domicilié|habite au|Vivo en|domicilio:|enviar a|entregar en|dirección|reside en||||".split("|"),
}
AFTER = ["", "", "", ".", ".", ".", ",", "!", "?", " today.", " yesterday.", " on Monday.", " tomorrow morning", " please", " again", " and waited.", " about the report.", " was there", " (work)", " (home)", " (private)", " at the office", " before noon.", ", thanks!", " asked for a copy.", " said the run was slow.", " since March.", " for the parcel", " if there is a question.", " heute.", " gestern", " am Freitag.", " wegen der Rechnung.", " bitte", " sagte ab.", " seit Mai.", " aujourd'hui.", " hier", " demain matin.", " svp", " pour le dossier.", " depuis juin.", " hoy.", " ayer", " mañana por la tarde.", " por favor", " sobre el pedido.", " desde abril.", ";", " -", ")", " | ", "..."]
KEY_WORDS = "name user owner author person customer client contact sender recipient mail email address street home phone mobile cell tel number id ident document passport doc ref note notes comment info text value field meta entry detail extra by from to of reply reported created updated signed location delivery shipping billing check kyc".split()


def json_key(r: random.Random) -> str:
    return r.choice(["_", "_", "", "-"]).join(r.sample(KEY_WORDS, r.choice([1, 2, 2])))


def carrier(r: random.Random, kind: str) -> str:
    """A sentence with {} where the item stands."""
    before = r.choice(BEFORE[kind])
    if r.random() < 0.12:  # any words of any language before it
        before = " ".join(syllables(r, 1, 2) for _ in range(r.randint(1, 4)))
    if before and r.random() < 0.12:
        before = before.upper() if r.random() < 0.3 else before.lower()
    lead = before + (" " if before else "")
    lead += r.choice(["<", "(", '"', "'", "\n", "- ", "* "]) if r.random() < 0.1 else ""
    after = r.choice(AFTER)
    if lead.endswith("<"):
        after = ">" + after
    elif lead.endswith("("):
        after = ")" + after
    elif lead[-1:] in ('"', "'"):
        after = lead[-1] + after
    return lead.replace("{", "").replace("}", "") + "{}" + after


#: Common words of which plain sentences around an item are made, by language.
COMMON = [
    "the a my our his their new old next last first when after before then will would can has had was were went came said told wrote met saw asked gave sent took made join called spoke signed lives works moved arrived left on in at to for with and but because about into from team office report meeting contract week house train letter book morning day friend colleague doctor teacher number".split(),
    "der die das ein eine mein unser neue alte wenn nach vor dann wird kann hat hatte war ging kam sagte schrieb traf fragte gab nahm rief wohnt arbeitet auf in an zu für mit und aber weil über aus am gestern heute Vertrag Bericht Woche Haus Zug Brief Buch Morgen Tag Freund Kollegin Nummer Termin unterschrieben bitte".split(),
    "le la les un une mon notre son nouveau quand après avant puis va peut a avait était dit écrit vu rencontré demandé donné envoyé pris appelé habite travaille sur dans à pour avec et mais parce que de du chez hier demain rapport semaine maison train lettre livre matin jour ami collègue numéro contrat".split(),
    "el la los un una mi nuestro su nuevo cuando después antes luego va puede ha había era dijo escribió vio pidió dio envió tomó llamó vive trabaja en a para con y pero porque de del ayer mañana informe semana casa tren carta libro día amigo colega número contrato por favor llame".split(),
]


def sentence(r: random.Random) -> str:
    """Common words of one language around {}."""
    pick = r.choice(COMMON)
    w = [r.choice(pick) for _ in range(r.randint(2, 9))]
    w.insert(r.randint(0, len(w)), "{}" + r.choice(["", "", "", ","]))
    out = " ".join(w)
    return out[0].upper() + out[1:] + r.choice(".!?.. ").strip()


def piece(r: random.Random, kind: str, carrier: str) -> tuple[str, list[tuple[int, int, str]]]:
    item = MAKE[kind](r)
    at = carrier.index("{}")
    return carrier.replace("{}", item), [(at, at + len(item), kind)]


def several(r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """Items in a row or below each other, as in signatures and letter heads."""
    out, spans = r.choice(["", "\n", "\n", "\n--\n", "\n" + r.choice(["Best regards", "Kind regards,", "Yours sincerely,", "Sincerely", "Best wishes", "Many thanks,", "Viele Grüße", "Mit freundlichen Grüßen", "Gruß,", "MfG", "Bien à vous,", "Cordialement", "Amicalement,", "Un saludo,", "Atentamente", "Saludos cordiales,"]) + "\n"]), []
    gap = r.choice(["\n", "\n", ", ", " ", " | ", "; ", " / "])
    kinds = r.sample(KINDS, r.randint(1, 4))
    if r.random() < 0.6:
        kinds = ["NAME", *[k for k in kinds if k != "NAME"]]
    for i, k in enumerate(kinds):
        if i:
            out += gap
        item = MAKE[k](r)
        wrap = k == "EMAIL" and r.random() < 0.2
        spans.append((len(out) + wrap, len(out) + wrap + len(item), k))
        out += f"<{item}>" if wrap else item
    return out, spans


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+", text) if s]


def hexes(r: random.Random) -> str:
    return "".join(r.choice("0123456789abcdef" if r.random() < 0.6 else "0123456789") for _ in range(r.randint(7, 14)))


def lookalike(r: random.Random) -> str:
    """What is no personal item though it looks like one."""
    n = r.randrange(10 ** r.randint(2, 6))
    word = lambda: syllables(r).capitalize()
    two = lambda: r.choice(["Query Planner", "Release Notes", "Machine Learning", "Open Source", "Memory Store", "New Year", "Customer Service", "Quality Control", "Deutsche Bahn", "United Nations", "Data Lake", "Best Practice", "Monday Morning", "Project Plan", "Graph Index"])
    return r.choice([
        *[hexes(r) for _ in range(8)], _digits(r, "0" * r.randint(7, 14)), _digits(r, "0" * 12), hexes(r).upper(), f"#{n}", f"{r.choice('ABCDEFGX')}{r.choice('XYZQRS')}-{n}", f"ticket {n}", f"Ticket #{n}", f"run-{hexes(r)[:7]}", f"build {n}", f"session {n}", f"s-{n}", f"order no. {n}", f"invoice {n}", f"version {n % 9}.{n % 23}.{n % 17}", f"v{n % 9}.{n % 23}", f"{n % 9}.{n % 20}.{n % 20}-{n % 999}",
        f"{r.randrange(1, 255)}.{r.randrange(255)}.{r.randrange(255)}.{r.randrange(255)}", f"20{r.randrange(10, 30)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}", f"20{r.randrange(10, 30)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d} {r.randrange(24):02d}:{r.randrange(60):02d}", f"{r.randrange(24):02d}:{r.randrange(60):02d}:{r.randrange(60):02d}", f"{r.randrange(1, 29)}.{r.randrange(1, 13)}.20{r.randrange(10, 30)}",
        f"{n / 100:.2f} EUR", f"{n} rows", f"{n} of {n + 7}", f"{n % 100} %", f"port {n % 65535}", f"{n} tokens in {word()}{word()}", f"txn {n}", f"transaction {n}", f"agent {word()}", f"the {word()} agent", f"project {word()}", f"Projekt {word()}", f"team {word()}", f"the town of {place(r)}", f"in {place(r)}", f"{place(r)} office", f"{word()} and {word()}", f"{word()}{word()}", f"{syllables(r)}_{syllables(r)}",
        two(), f"{two()} {word()}", f"{r.choice(FIRST)}", f"{r.choice(FIRST)}'s note", f"the {surname(r)} method", f"{word()} for {word()}", f"Between {word()}{word()} and {word()}", f"From {word()} to {word()}", f"line {n}", f"chapter {n % 40}", f"page {n % 900}", f"{word()} Street view", f"Route {n % 99}", f"room {n % 400}", f"level {n % 9}", f"error {n % 600}", f"code {n}", f"@{syllables(r)}", f"{n} at {n + 1}",
    ])


def noisy(r: random.Random, text: str) -> str:
    """Other writings of a text without personal items: case, lost signs, lookalikes mixed in."""
    x = r.random()
    if x < 0.15:
        return text.upper()
    if x < 0.2:
        return text.lower()
    if x < 0.26:
        return text.title()
    if x < 0.4:
        return "".join(c if c.isalnum() or c in " \n_" or r.random() < 0.4 else r.choice(["", " "]) for c in text)
    words = text.split(" ")
    for _ in range(r.randint(1, 4)):
        words.insert(r.randint(0, len(words)), lookalike(r))
    return " ".join(words)


def generated(r: random.Random) -> str:
    """A text of no corpus, without items."""
    out = []
    for _ in range(r.randint(1, 4)):
        pick = r.choice(COMMON)
        w = [syllables(r, 1, 3) if r.random() < 0.3 else r.choice(pick) for _ in range(r.randint(3, 12))]
        if r.random() < 0.5:
            w.insert(r.randint(0, len(w)), lookalike(r))
        out.append(" ".join(w).capitalize() + r.choice(".!?.."))
    return " ".join(out)


def example(r: random.Random, background: list[str], metadata: list[str]) -> tuple[str, list[tuple[int, int, str]]]:
    x = r.random()
    text = r.choice(background) if background and r.random() < 0.85 else generated(r)
    base = r.choice(metadata) if metadata and r.random() < 0.9 else "{}"
    if x < 0.15:
        return text, []
    if x < 0.29:
        return noisy(r, text), []
    if x < 0.36:
        more = "".join(f', "{json_key(r)}": "{lookalike(r) if r.random() < 0.8 else generated(r)}"' for _ in range(r.randint(0, 3)))
        return (base[:-1] + more + "}" if base.endswith("}") else base), []
    if x < 0.56:
        base = base[:-1] if base.endswith("}") and len(base) > 2 else '{"v": 1'
        spans: list[tuple[int, int, str]] = []
        for _ in range(r.choice([1, 1, 2, 3])):
            kind = r.choice(KINDS)
            body, sp = piece(r, kind, "{}") if r.random() < 0.5 else piece(r, kind, carrier(r, kind).replace('"', "'"))
            shape = r.random()
            lead = f', "{json_key(r)}": ' + ('{"' + json_key(r) + '": "' if shape < 0.25 else '["' if shape < 0.4 else '"')
            spans += [(a + len(base) + len(lead), z + len(base) + len(lead), k) for a, z, k in sp]
            base += lead + body + '"' + ("}" if shape < 0.25 else "]" if shape < 0.4 else "")
        return base + "}", spans
    if r.random() < 0.15:
        text = noisy(r, text)
    parts: list[tuple[str, list]] = [(s, []) for s in sentences(text)]
    for _ in range(r.choice([1, 1, 2, 3])):
        kind = r.choice([*KINDS, "NAME", "NAME"])
        at = r.randint(0, len(parts))
        if r.random() < 0.3 and at < len(parts) and not parts[at][1] and "{" not in parts[at][0]:  # in the middle of a sentence
            words = parts[at][0].split(" ")
            words.insert(r.randint(0, len(words)), "{}" + r.choice(["", "", "", ","]))
            parts[at] = piece(r, kind, " ".join(words))
        else:
            parts.insert(at, piece(r, kind, carrier(r, kind) if r.random() < 0.75 else sentence(r)))
    out, spans = "", []
    for s, sp in parts:
        spans += [(a + len(out), z + len(out), k) for a, z, k in sp]
        out += s + (" " if r.random() < 0.93 else "\n")
    if r.random() < 0.3:
        s, sp = several(r)
        out = out.rstrip()
        if not s.startswith("\n"):
            out += r.choice([" ", "\n"])
        spans += [(a + len(out), z + len(out), k) for a, z, k in sp]
        out += s
    y = r.random()
    if y < 0.06 and len(out.upper()) == len(out):
        out = out.upper()
    elif y < 0.1 and len(out.lower()) == len(out):
        out = out.lower()
    return out, spans


def windows(r: random.Random, background: list[str], metadata: list[str], batch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.full((TRAINED, batch), PAD, np.int16)
    y = np.zeros((TRAINED, batch), np.int64)
    n = np.zeros(batch, np.int64)
    for j in range(batch):
        text, spans = example(r, background, metadata)
        c = codes(text)
        t = np.zeros(len(c), np.int64)
        for a, z, k in spans:
            i = KINDS.index(k)
            t[a] = 1 + 2 * i
            t[a + 1 : z] = 2 + 2 * i
        s = 0
        if len(c) > TRAINED:
            s = min(max(0, r.choice(spans)[0] - r.randint(0, TRAINED - 20)), len(c) - TRAINED) if spans and r.random() < 0.8 else r.randint(0, len(c) - TRAINED)
        c, t = c[s : s + TRAINED], t[s : s + TRAINED]
        x[: len(c), j], y[: len(c), j], n[j] = c, t, len(c)
    return x, y, n


def crf(e: np.ndarray, y: np.ndarray, n: np.ndarray, p: dict) -> tuple[float, np.ndarray, dict]:
    """Mean negative log-likelihood by character and its gradients, by scaled forward and backward sums."""
    t_len, b, k = e.shape
    cols = np.arange(b)
    e = e.astype(np.float64)
    live = np.arange(t_len)[:, None] < n[None]
    top = e.max(axis=2)
    w = np.exp(e - top[:, :, None])
    a, first, end = (np.exp(p[x].astype(np.float64)) for x in ("trans", "start", "end"))
    alpha, beta, scale = np.empty_like(e), np.empty_like(e), np.ones((t_len, b))
    for t in range(t_len):
        new = w[0] * first if t == 0 else (alpha[t - 1] @ a) * w[t]
        scale[t] = np.where(live[t], new.sum(axis=1), 1.0)
        alpha[t] = new / scale[t][:, None] if t == 0 or live[t].all() else np.where(live[t][:, None], new / scale[t][:, None], alpha[t - 1])
    z_end = alpha[-1] @ end
    beta[-1] = end
    for t in range(t_len - 2, -1, -1):
        new = ((w[t + 1] * beta[t + 1]) @ a.T) / scale[t + 1][:, None]
        beta[t] = new if live[t + 1].all() else np.where(live[t + 1][:, None], new, beta[t + 1])
    total = float(n.sum())
    de = np.where(live[:, :, None], alpha * beta / z_end[None, :, None], 0)
    after = np.where(live[1:, :, None], w[1:] * beta[1:] / (scale[1:] * z_end[None])[:, :, None], 0)
    dtr = a * np.tensordot(alpha[:-1], after, ([0, 1], [0, 1]))
    last = n - 1
    dstart, dend = de[0].sum(axis=0), de[last, cols].sum(axis=0)
    gold = e[np.arange(t_len)[:, None], cols[None], y]
    loss = np.log(scale).sum() + (top * live).sum() + np.log(z_end).sum() - (gold * live).sum() - p["start"][y[0]].sum() - p["end"][y[last, cols]].sum()
    both = live[1:]
    loss -= (p["trans"][y[:-1], y[1:]] * both).sum()
    np.subtract.at(dtr, (y[:-1][both], y[1:][both]), 1)
    np.subtract.at(dstart, y[0], 1)
    np.subtract.at(dend, y[last, cols], 1)
    tt, bb = np.nonzero(live)
    de[tt, bb, y[tt, bb]] -= 1
    return loss / total, (de / total).astype(np.float32), {"trans": dtr / total, "start": dstart / total, "end": dend / total}


def gradients(m: Tagger, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, dict]:
    h = m.p["hf"].shape[0]
    f, cf = m.run(x, "f", True)
    b, cb = m.run(x[::-1], "b", True)
    both = np.concatenate((f, b[::-1]), axis=2)
    loss, de, g = crf(both @ m.p["out"] + m.p["bo"], y, n, m.p)
    g["out"] = np.tensordot(both, de, ([0, 1], [0, 1]))
    g["bo"] = de.sum(axis=(0, 1))
    dh = de @ m.p["out"].T
    for d, seq, cache, up in (("f", x, cf, dh[:, :, :h]), ("b", x[::-1], cb, dh[::-1, :, h:])):
        w = m.p["h" + d]
        dz = np.empty((*seq.shape, 4 * h), np.float32)
        gw = np.zeros_like(w)
        nh = nc = 0
        for t in range(len(seq) - 1, -1, -1):
            ifo, gate, prev, tc, before = cache[t]
            i, fo, o = ifo[:, :h], ifo[:, h : 2 * h], ifo[:, 2 * h :]
            a = up[t] + nh
            dc = a * o * (1 - np.abs(tc)) ** 2 + nc
            q = dz[t]
            slope = 0.5 * (1 - np.abs(2 * ifo - 1)) ** 2
            q[:, :h] = dc * gate * slope[:, :h]
            q[:, h : 2 * h] = dc * prev * slope[:, h : 2 * h]
            q[:, 2 * h : 3 * h] = a * tc * slope[:, 2 * h :]
            q[:, 3 * h :] = dc * i * (1 - np.abs(gate)) ** 2
            gw += before.T @ q
            nh, nc = q @ w.T, dc * fo
        flat = dz.reshape(-1, 4 * h)
        gx = np.zeros_like(m.p["x" + d])
        order = np.argsort(seq.ravel(), kind="stable")
        sorted_codes = seq.ravel()[order]
        begin = np.flatnonzero(np.concatenate(([True], sorted_codes[1:] != sorted_codes[:-1])))
        gx[sorted_codes[begin]] = np.add.reduceat(flat[order], begin, axis=0)
        g["x" + d], g["h" + d], g["b" + d] = gx, gw, flat.sum(axis=0)
    return loss, g


def _worker(pipe, seed: int, background: list[str], metadata: list[str], batch: int) -> None:
    r = random.Random(seed)
    while (p := pipe.recv()) is not None:
        loss, g = gradients(Tagger(p), *windows(r, background, metadata, batch))
        pipe.send((loss, {k: v.astype(np.float32) for k, v in g.items()}))


def train(background: list[str], metadata: list[str], steps: int, batch: int = 64, h: int = HIDDEN, seed: int = 1, rate: float = 6e-3, processes: int = 1, start: Tagger | None = None, tell: bool = True) -> Tagger:
    m = start or Tagger.fresh(h)
    m1, m2 = {k: np.zeros_like(v) for k, v in m.p.items()}, {k: np.zeros_like(v) for k, v in m.p.items()}
    began, mean = time.time(), 0.0
    spawn = multiprocessing.get_context("fork")
    pipes = []
    for i in range(processes):
        mine, theirs = spawn.Pipe()
        spawn.Process(target=_worker, args=(theirs, seed * 1000 + i, background, metadata, batch), daemon=True).start()
        pipes.append(mine)
    for s in range(1, steps + 1):
        for pipe in pipes:
            pipe.send(m.p)
        got = [pipe.recv() for pipe in pipes]
        loss = sum(x for x, _ in got) / processes
        g = {k: sum(x[k] for _, x in got) / processes for k in m.p}
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        lr = rate * min(1, s / 50) * (0.5 * (1 + np.cos(np.pi * s / steps)) + 0.01)
        for k, v in g.items():
            v = (v * min(1.0, 1.0 / max(norm, 1e-9))).astype(np.float32)
            m1[k] += 0.1 * (v - m1[k])
            m2[k] += 0.002 * (v * v - m2[k])
            m.p[k] = m.p[k] - (lr * (m1[k] / (1 - 0.9**s)) / (np.sqrt(m2[k] / (1 - 0.998**s)) + 1e-8)).astype(np.float32)
        mean = loss if s == 1 else 0.98 * mean + 0.02 * loss
        if tell and s % 100 == 0:
            print(s, round(mean, 5), f"{time.time() - began:.0f} s", flush=True)
    for pipe in pipes:
        pipe.send(None)
    return m


def cleaned(m: Tagger, texts: list[str]) -> list[str]:
    """The texts in which ``m`` finds no item."""
    return [t for t, tags in zip(texts, m.tag([codes(t) for t in texts]), strict=True) if not tags.any()]


def main(path: str, steps: int, processes: int) -> None:
    import pyarrow.dataset as ds

    from graphloom.llm.p2_model import units

    t = ds.dataset(path).head(SAMPLE, columns=["content", "metadata"])
    background = [units(x)[0] for x in t.column("content").to_pylist() if x and x.strip()]
    metadata = [units(x)[0] for x in t.column("metadata").to_pylist() if x and x.strip()]
    weights = Path(__file__).with_name("p2_weights.npz")
    first = Tagger.load(weights) if weights.exists() else train([], [], steps // 3, processes=processes)
    background, metadata = cleaned(first, background), cleaned(first, metadata)
    print("clean texts", len(background), len(metadata), flush=True)
    m = train(background, metadata, steps, seed=2, processes=processes)
    np.savez_compressed(weights, **{k: v.astype(np.float16) for k, v in m.p.items()})
    r = random.Random(99)
    texts = [example(r, background, metadata) for _ in range(400)]
    tags = m.tag([codes(t) for t, _ in texts])
    good = sum({(i, KINDS[(v - 1) // 2]) for i, v in enumerate(tg) if v % 2 == 1} == {(a, k) for a, _, k in sp} for (_, sp), tg in zip(texts, tags, strict=True))
    print("texts with all starts right", good, "of", len(texts), N)


if __name__ == "__main__":
    main(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 1500, int(sys.argv[3]) if len(sys.argv) > 3 else 4)
