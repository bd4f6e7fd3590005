"""Word lists and variant spellings that label rules go by."""

from __future__ import annotations

# Marker words by type, title words, number words, variant spellings and opposite
# directions. Results depend on exactly these words.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth".split()
STOPWORDS = "the of as at in on for to from and or with by a an".split()
TITLES = "mingyi maha min thado thadoe nemyo naymyo ne myo prince princess king queen minister governor sayadaw shin lord chief royal city town village commander wundauk myosa myoza wun bo clerk u nga maung lady sir siri thiri zeya thiha kyaw htin sithu nawrahta raza yaza pyan chi thura thihathu minkhaung minhkaung minhla hla sawbwa regiment unit troops force forces group officials people men soldiers cavalry musketeer musketeers monk monks sangha".split()
KINSHIP = "son daughter sister brother niece nephew mother father wife husband queen consort grandfather grandmother uncle aunt".split()
GROUPS = "unit regiment battalion troop troops force forces family followers associates residents personnel staff people men soldiers cavalry musketeer musketeers commanders ministers officials monks sayadaws sangha group corps fleet".split()
HARD_GROUPS = "unit regiment battalion troop troops force forces family followers associates residents personnel staff group corps fleet".split()
EVENTS = "campaign expedition battle assault attack capture arrest ceremony festival festivals prophecy funeral consecration offering offerings merit making appointment rebellion procession ritual construction birth death".split()
PLACES = "city town village fort pagoda monastery river stream palace hill mountain region state kingdom dynasty canal lake ward district route camp portico chamber face side capital".split()
PERSONS = "prince princess king queen minister governor sayadaw shin lord chief commander clerk sawbwa myosa myoza maung nga u lady wife son daughter sister brother niece nephew".split()
OBJECTS = "elephant elephants horse horses boat boats barge umbrella weapon weapons cannon cannons musket muskets statue image images tree trees robe robes coin coins textile textiles".split()
INSTITUTIONS = "court hluttaw government authorities monarchy dynasty state sangha".split()
PERSONAL = "nga maung ma u".split()
AXES = [
    ("left letwe letwa".split(), "right letya".split()),
    ("north northern northeast northwest".split(), "south southern southeast southwest".split()),
    ("east eastern northeast southeast".split(), "west western northwest southwest".split()),
    ("front forward".split(), "rear back".split()),
    ("inner interior".split(), "outer exterior".split()),
    ("upper upstream".split(), "lower downstream".split()),
    ("elder older eldest".split(), "younger youngest".split()),
    ("winning winner".split(), "losing loser".split()),
    (["male"], ["female"]),
]
VARIANTS = {"myoza": "myosa", "naymyo": "nemyo", "minhgaung": "minhkaung", "pawara": "pavara", "thurain": "thurein", "kyawzwa": "kyawswa", "kyawswar": "kyawswa", "hlahtwe": "hlatwe", "oakkyaung": "okkyaung", "thadoe": "thado", "pannadipa": "panyadipa", "myinkhuntaing": "myinkhontine"}
VARIANT_PAIRS = {"min hla": "minhla", "min htin": "minhtin", "min khaung": "minkhaung", "min kyaw": "minkyaw", "kyaw swa": "kyawswa", "kyaw zwa": "kyawswa", "shwe taung": "shwetaung", "ne myo": "nemyo", "ok kyaung": "okkyaung", "nakhan daw": "nakhandaw", "myin gun": "myingun"}
# End of the fixed values.

#: Type of an entity by the marker words among its tokens, in the order in which types are listed.
TYPES = {"group": GROUPS, "event": EVENTS, "place": PLACES, "person": PERSONS, "object": OBJECTS, "institution": INSTITUTIONS}
