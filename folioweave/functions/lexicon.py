"""The word lists, patterns and limits that results must agree on. Plain text, no logic."""

# English words that never make a name of their own (function words, honorifics, months, days).
STOPWORDS = (
    "The This That These Those It We You They He She I A An And But Or If For In On At To Of As By Is Are Was Were Be Section "
    "Figure Table Chapter Note Page However Therefore Dr Mr Mrs Ms Prof Sir Mx St Md Mohd Mohammad Mohammed Muhammad Engr Eng Adv "
    "Begum Ignore New Normal Please See Using Based Following Given Each Both All Some Many Most Such Other Overall Total January "
    "February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday "
    "Saturday Sunday Meeting"
).split()
LEADING = "The A An This That These Those".split()

# Survey cells, compared in lower case.
VALUE_WORDS = (
    "male female yes no na nan none null other others husband wife son daughter father mother brother sister self head spouse child "
    "children family member rural urban married unmarried single widow widowed divorced primary secondary illiterate literate "
    "muslim hindu christian true false high low medium good poor average total name age sex gender address phone mobile date status "
    "type category amount number count code id sl serial n/a nil tk taka pcs kg hh unnamed"
).split()

# Bengali particles that neither begin nor end a name.
BENGALI_STOP = (
    "এবং ও বা এই সেই যে যা তার তাদের এর ের টি টা করা করে করেন হয় হয়েছে হবে ছিল জন জনের থেকে জন্য সাথে মধ্যে কাছে পর আগে কিন্তু তবে যদি "
    "নয় না কে একটি একটা অংশগ্রহণকারী প্রধান মোঃ মোছাঃ জনাব"
).split()
BENGALI_DIGITS = "০১২৩৪৫৬৭৮৯"

# Words that type a name, places and organisations known by name.
HONORIFICS = "Dr Mr Mrs Ms Md Mohd Mohammad Mohammed Muhammad Prof Engr Eng Adv Begum".split()
ORG_WORDS = (
    "Authority Programme Program Foundation Association Ministry Department Bank University College School Institute Committee "
    "Council Commission Corporation Company Ltd Inc Corp Co Network Unit Office Agency Society Federation Union Group Limited"
).split()
PLACE_WORDS = "District Division Upazila Union Village City Town Region Zone Sub-district Thana Ward".split()
DIVISIONS = "Dhaka Chattogram Chittagong Rajshahi Khulna Barishal Barisal Sylhet Rangpur Mymensingh".split()
DISTRICTS = (
    "Comilla Cumilla Feni Brahmanbaria Rangamati Noakhali Chandpur Lakshmipur Laxmipur Coxsbazar Khagrachhari Bandarban Narsingdi "
    "Gazipur Narayanganj Tangail Kishoreganj Kishoregonj Manikganj Munshiganj Rajbari Madaripur Gopalganj Faridpur Shariatpur "
    "Sirajganj Sirajgonj Pabna Bogura Bogra Natore Joypurhat Chapainawabganj Naogaon Jashore Jessore Satkhira Meherpur Narail "
    "Chuadanga Kushtia Magura Bagerhat Jhenaidah Jhenidah Barguna Bhola Jhalokathi Jhalakathi Patuakhali Pirojpur Sunamganj "
    "Sunamgonj Habiganj Habigonj Moulvibazar Maulvibazar Panchagarh Dinajpur Lalmonirhat Nilphamari Gaibandha Thakurgaon Kurigram "
    "Jamalpur Sherpur Netrokona Netrakona"
).split()
KNOWN_ORGS = "BRAC UPGP DIUPG BIGD VSSC CFPR BIDS".split()

# Finer types by word, the first that fits.
ORG_SUBTYPES = {
    "government": "Ministry Department Authority Commission Council Committee Agency Bureau Directorate Government Parishad".split(),
    "financial": "Bank Fund Finance Microfinance Insurance Credit".split(),
    "education": "University College School Institute Academy Madrasa Madrasah".split(),
    "nonprofit": "Foundation Association Society Trust Federation NGO Charity".split(),
    "company": "Corporation Company Ltd Inc Corp Limited Co GmbH LLC PLC Industries Enterprise Enterprises".split(),
}
PLACE_SUBTYPES = {
    "division": ["Division"],
    "district": ["District"],
    "upazila": ["Upazila", "Thana", "Sub-district"],
    "city": ["City"],
    "town": ["Town"],
    "union": ["Union"],
    "village": ["Village"],
    "region": ["Region", "Zone"],
    "ward": ["Ward"],
}

# Verbs that relate two names, in the order in which they are tried; between them at most GAP characters.
CUES = [
    ("operates", r"operates?|runs?|manages?|administers?"),
    ("leads", r"leads?|directs?|heads?|chairs?|oversees?"),
    ("founded", r"founded|established|created|launched"),
    ("acquired", r"acquired|bought|purchased"),
    ("approved", r"approved|signed|authorised|authorized"),
    ("works_for", r"reports?\s+to|works?\s+for|employed\s+by|member\s+of"),
    ("located_in", r"located\s+in|based\s+in|headquartered\s+in|situated\s+in"),
    ("part_of", r"part\s+of|belongs?\s+to|owned\s+by|subsidiary\s+of|division\s+of"),
    ("supplies", r"supplies|supplied|provides?|delivers?"),
]
GAP = 40

# Abbreviations after which the extractor ends no sentence.
ABBREVIATIONS = "Dr Mr Mrs Ms Prof Sr Jr St Inc Ltd Co Corp vs etc No Fig Eq Vol Rev Gen Sen Rep".split()

# Control tokens of chat formats, data fences, and tags of metadata dumps.
CONTROL_NAMES = "tool_call|tool_response|think|thinking|im_start|im_end|start_of_turn|end_of_turn|start_header_id|end_header_id|eot_id"
FENCE_NAMES = "DATA|CHUNK|END"
METADATA_TAGS = ["<xapG:", "<x:xmpmeta", "xmlns:rdf", "<rdf:"]

# Words that don't count as topical overlap, beside the stop words above.
OVERLAP_WORDS = "best recipe new total overall part using good report data information general various different make made".split()

# File types by extension.
TEXT_EXTENSIONS = "txt md markdown text log rst".split()
DATA_EXTENSIONS = "csv tsv json xml yaml yml ndjson".split()
IMAGE_EXTENSIONS = "png jpg jpeg bmp gif tiff tif webp".split()
AUDIO_EXTENSIONS = "wav mp3 m4a flac ogg aac".split()
VIDEO_EXTENSIONS = "mp4 mov avi mkv webm m4v wmv flv mpg mpeg".split()
FONT_EXTENSIONS = "otf ttf ttc woff woff2 eot".split()
POINTER_EXTENSIONS = "gdoc gsheet gform gdrive gslides gdraw gmap gsite".split()
JUNK_EXTENSIONS = "tmp ds_store ini lnk crdownload part".split()
JUNK_NAMES = [".ds_store", "thumbs.db", "desktop.ini", "icon\r"]
OFFICE_EXTENSIONS = "pdf docx pptx xlsx xls html htm epub msg rtf doc ppt".split()
ARCHIVE_EXTENSIONS = "zip tar tgz tbz2 txz gz bz2 xz rar 7z".split()

# Bytes that a returned field may take, and how many items lists may hold.
LABEL_BYTES, TEXT_BYTES, DOC_BYTES, SYNOPSIS_BYTES = 200, 600, 160, 1200
HIT_DOCS, HIT_SPANS, THEMES_SHOWN, LISTED = 5, 5, 20, 50
