"""Which words of a source's own label, of a title or of a description tell a genre, and which tell that a date is no concert."""

# Tags by what a source calls the genre, in order.
SITE_RULES = [
    ("metal", r"\bmetal|death|black metal|doom|thrash|hardcore|metalcore|grind|sludge|stoner"),
    ("punk", r"(?<!post-)(?<!post )(?<!post- )\bpunk|\boi\b|crust|emo\b"),
    ("indie", r"post[- ]{0,2}punk|\b(dark|cold|new) ?wave\b(?! of)|\bgoth(ic|ique)?\b(?! metal)|shoegaze|garage|psych|noise pop|dream pop|indie|lo-?fi|math rock|krautrock|alternati|bedroom"),
    ("rock", r"\brock|grunge"),
    ("electro", r"techno|house|electro|electronic|electronique|electronica|synth|ambient|drum ?(and|&|n) ?bass|dnb|dubstep|bass music|rave|dj|hyperpop|idm|trance|edm|breakbeat|acid|club"),
    ("hip-hop", r"hip[- ]?hop|\brap\b|\btrap\b|\bdrill\b|grime|boom bap"),
    ("soul-rnb", r"\bsoul|r ?['&n]? ?b\b|rnb|motown|gospel"),
    ("funk", r"\bfunk|groove|disco\b|boogie"),
    ("jazz", r"\bjazz|bebop|be-bop|swing\b|\bjam\b|big band"),
    ("blues", r"\bblues\b"),
    ("folk", r"\bfolk|americana|bluegrass|country|singer[- ]?songwriter|acoustique|acoustic"),
    ("chanson", r"chanson|variete|francaise|french pop|cabaret"),
    ("afro", r"\bafro|highlife|amapiano|coupe[- ]decale|zouk|kizomba|soukous"),
    ("latin", r"\blatin|cumbia|salsa|bossa|samba|reggaeton|tango|flamenco|bachata|forro|mariachi|cubain|bresil"),
    ("reggae", r"reggae|\bdub\b|\bska\b|ragga|dancehall|rocksteady"),
    ("world", r"world|musiques? du monde|traditionnel|oriental|balkan|celtique|tzigane|gnawa|\brai\b|arabe|klezmer|fado|manouche|africain|maloya|kabyle|turc|persan|indienne"),
    ("classical", r"classique|classical|symphon|orchestr|philharmon|\bopera\b|baroque|recital|quatuor|chambre|chamber|choeur|chorale|lyrique|musique ancienne"),
    ("experimental", r"experiment|\bnoise\b|drone|impro|avant[- ]garde|free jazz|contemporain|sound art"),
    ("pop", r"\bpop\b|k-?pop|j-?pop|synthpop|electropop|dance pop"),
]

# Tags by words of a title or description, in order.
TEXT_RULES = [
    ("metal", r"\b(metal|black metal|death metal|doom|thrash|metalcore|grindcore|sludge)\b"),
    ("punk", r"(?<!post-)(?<!post )(?<!post- )\bpunk\b|\bhardcore\b"),
    ("indie", r"\b(post[- ]{0,2}punk|darkwave|coldwave|shoegaze|garage rock|psych(edelic|e)?|indie|krautrock)\b"),
    ("rock", r"\b(rock|grunge|rock'?n'?roll|rock and roll)\b"),
    ("electro", r"\b(techno|electro|electronic|electronique|dj set|rave|drum ?(and|&|n) ?bass|dubstep|hyperpop|trance|clubbing|dj)\b"),
    ("hip-hop", r"\b(hip-?hop|rap|trap|drill|grime)\b"),
    ("soul-rnb", r"\b(soul|r'?n'?b|rnb|r&b|gospel|motown)\b"),
    ("funk", r"\b(funk|disco|boogie)\b"),
    ("jazz", r"\b(jazz|bebop|be-bop|jam session|jam|big band|quartet|quintet|sextet|trio|hommage a (dizzy|clifford|coltrane|miles|monk|bill evans|chet baker))\b"),
    ("blues", r"\bblues\b"),
    ("folk", r"\b(folk|americana|bluegrass|singer-?songwriter)\b"),
    ("chanson", r"\b(chanson francaise|chanson|variete)\b"),
    ("afro", r"\b(afrobeat|afrobeats|amapiano|highlife|coupe-decale|zouk|kizomba)\b"),
    ("latin", r"\b(cumbia|salsa|bossa nova|bossa|samba|reggaeton|tango|flamenco|bachata|forro|piazzolla|cubain|cubaine|bresilien|bresilienne|latino)\b"),
    ("reggae", r"\b(reggae|ska|ragga|dancehall|rocksteady)\b"),
    ("world", r"\b(musiques? du monde|musique traditionnelle|oriental|orientale|balkan|balkanique|celtique|tzigane|gnawa|klezmer|fado|manouche|maloya|kabyle|persan|persane|qawwali)\b"),
    ("classical", r"\b(classique|symphonie|symphonique|orchestre (de|national|philharmonique|symphonique|du|des|de chambre)|philharmonie|opera|baroque|recital|quatuor|musique de chambre|choeur|chorale|requiem|oratorio|cantate|sonate|lieder|mahler|beethoven|mozart|bach|chopin|schubert|brahms|debussy|ravel|vivaldi|haydn|haendel|handel|rachmaninov|tchaikovski|schumann|liszt|puccini|verdi|wagner)\b"),
    ("experimental", r"\b(experimental|experimentale|noise|drone|avant-garde|free jazz|musique contemporaine|musiques? improvisees?)\b"),
    ("pop", r"\b(pop|k-?pop|j-?pop|synthpop|electropop)\b"),
]

# Words of dates that are no concert, and words that make them one all the same.
NON_MUSIC = r"\b(humour|humor|one man show|one woman show|stand-?up|sketch|theatre|theater|piece de theatre|conference|debat|projection|cinema|film|expo|exposition|vernissage|atelier|workshop|marche|brocante|vide-?grenier|brunch|food|yoga|sport|bingo|quiz|karaoke|lecture|litterature|dedicace|visite|balade|spectacle vivant|danse contemporaine|cirque|magie|hypnose|drag|cabaret burlesque|jeux|gaming|comedie|comedy|podcast|radio|talk|masterclass|salon|forum|vente de vinyles|record fair|speed dating|loto|fete foraine|kermesse|enfants|jeune public|jeunesse|lancement du livre|livre|book launch|rencontre|signature|repas|diner|degustation|marche de noel|braderie)\b"
MUSIC_HINT = r"\b(concerts?|live|musique|music|musical|dj|club|festival|jam|tribute|release party|showcase|tournee|tour|orchestre|quartet|trio)\b"

# Spellings of sub-genres, by key or by key without blanks.
SPELLINGS = {
    "indiepop": "indie pop", "darkpop": "dark pop", "electronicrock": "electronic rock", "bossanova": "bossa nova", "synth pop": "synth-pop",
    "synthpop": "synth-pop", "post punk": "post-punk", "postpunk": "post-punk", "post rock": "post-rock", "postrock": "post-rock",
    "post hardcore": "post-hardcore", "post metal": "post-metal", "trip hop": "trip-hop", "triphop": "trip-hop", "neo soul": "neo-soul",
    "neosoul": "neo-soul", "nu jazz": "nu-jazz", "nu metal": "nu-metal", "lo fi": "lo-fi", "lofi": "lo-fi",
    "drum and bass": "drum & bass", "drum n bass": "drum & bass", "drum'n'bass": "drum & bass", "dnb": "drum & bass", "d'n'b": "drum & bass",
    "psyche rock": "psychedelic rock", "psych rock": "psychedelic rock", "psyche": "psychedelic", "psych": "psychedelic", "kpop": "k-pop",
    "jpop": "j-pop", "rock alternatif": "alternative rock", "alt rock": "alternative rock", "afro beat": "afrobeat", "chanson realiste": "chanson réaliste",
    "rap francais": "rap français", "pop francaise": "pop française", "musique contemporaine": "contemporain", "musiques improvisees": "impro", "musique improvisee": "impro",
}
# Labels that only repeat a genre or name a format.
COARSE = [
    "club", "clubbing", "dj set", "djset", "dj", "tribute", "showcase", "release party", "jam session", "jam",
    "open mic", "karaoke", "soiree", "party", "gig", "rock", "indie", "pop", "metal", "punk",
    "electro", "electronic", "electronica", "electronique", "electronic music", "musiques electroniques", "musique electronique", "hip-hop", "hip hop", "hiphop",
    "rap", "soul", "rnb", "r&b", "r'n'b", "soul-rnb", "soul/r&b", "funk", "jazz", "blues",
    "folk", "chanson", "chanson francaise", "world", "world music", "musiques du monde", "musique du monde", "musiques traditionnelles", "musique traditionnelle", "traditionnel",
    "latin", "latino", "afro", "reggae", "classical", "classique", "musique classique", "experimental", "experimentale", "variete",
    "variete francaise", "variete internationale", "alt", "alternative", "alternatif", "concert", "concerts", "festival", "live", "musique",
    "music",
]
# What a style's name has in it; beginnings that name a format.
STYLE = r"pop|rock|punk|metal|core\b|wave\b|gaze\b|jazz|\bsoul|funk|folk|blues|hop\b|\brap\b|\btrap\b|house\b|techno|electro|ambient|drone|noise|psych|garage|\bsurf|indie|\bemo\b|\bska\b|\bdub|reggae|cumbia|bossa|samba|salsa|tango|afro|latin|chanson|variete|classique|baroque|opera|trance|disco|boogie|groove|grunge|stoner|doom|sludge|thrash|\bdeath\b|grind|dream|synth|kraut|lo-?fi|acousti|americana|bluegrass|country|gospel|klezmer|fado|flamenco|manouche|swing|bebop|experiment|impro|k-?pop|j-?pop|\bdnb\b|dubstep|breakbeat|\bacid\b|\bidm\b|\bedm\b|\brave\b|ragga|dancehall|rocksteady|zouk|kizomba|amapiano|highlife|gnawa|balkan|celti|tzigane|oriental|traditionnel|musette|yeye|industrial|goth|\bprog|batucada|forro|mariachi|reggaeton|bachata|kompa|\bsega\b|fusion|\btrad|beat|musique|\brnb\b|r&b|r'n'b|\bdrill\b|\bgrime\b|\bneo|chill|downtempo|minimal|chamber|choral|lieder|symphon|orchestr|qawwali|maloya|kabyle|persan|\bturc|indien|contemporain|\bworld|electroni|hardcore|shoegaze|crust|\balt\b|alternati|\bbass\b|\bbreaks\b|\bjungle\b|footwork|\bbounce\b|ballroom"
FORMAT = r"^(tribute|hommage|soiree|nuit|special|spéciale?)\b"
