"""Fixed schemas as DDL text: nodes, edges, source files and search results. Nothing is inferred."""

from __future__ import annotations

from dataclasses import dataclass

VECTOR = "array<float>"

#: Label to columns; a null vector means that the node isn't embedded.
NODES = {
    "Volume": "id string not null, name string, abbreviation string",
    "Book": "id string not null, name string, slug string, urlPath string",
    "Chapter": f"id string not null, number int, summary string, summaryEmbedding {VECTOR}, url string",
    "Verse": "id string not null, number int, reference string, text string, translationNotes string, alternateReadings string, explanatoryNotes string",
    "VerseGroup": f"id string not null, text string, startVerseNumber int, endVerseNumber int, embedding {VECTOR}",
    "TopicalGuideEntry": f"id string not null, name string, embedding {VECTOR}",
    "BibleDictEntry": f"id string not null, name string, text string, embedding {VECTOR}",
    "IndexEntry": f"id string not null, name string, embedding {VECTOR}",
    "JSTPassage": f"id string not null, book string, chapter string, comprises string, compareRef string, summary string, text string, embedding {VECTOR}",
}
VECTOR_FIELD = {"VerseGroup": "embedding", "Chapter": "summaryEmbedding", "TopicalGuideEntry": "embedding", "BibleDictEntry": "embedding", "IndexEntry": "embedding", "JSTPassage": "embedding"}
ENTITY_TYPE = {"VerseGroup": "verse_group", "Chapter": "chapter", "TopicalGuideEntry": "topical_guide", "BibleDictEntry": "bible_dict", "IndexEntry": "index", "JSTPassage": "jst_passage", "Verse": "verse"}


@dataclass(frozen=True)
class Relationship:
    """An edge type; every field that names it reads the same table, IN fields with the ends swapped."""

    type: str
    source: str
    target: str
    properties: str = ""

    @property
    def schema(self) -> str:
        return "src_id string, dst_id string" + (f", {self.properties}" if self.properties else "")


RELATIONSHIPS = (
    Relationship("CONTAINS", "Volume", "Book"),
    Relationship("CONTAINS", "Book", "Chapter"),
    Relationship("HAS_VERSE", "Chapter", "Verse"),
    Relationship("HAS_GROUP", "Chapter", "VerseGroup"),
    Relationship("INCLUDES", "VerseGroup", "Verse"),
    Relationship("CROSS_REF", "Verse", "Verse", "category string, footnoteMarker string, referenceText string, targetEndVerseId string"),
    Relationship("TG_FOOTNOTE", "Verse", "TopicalGuideEntry", "footnoteMarker string, tgTopicText string, referenceText string"),
    Relationship("BD_FOOTNOTE", "Verse", "BibleDictEntry", "footnoteMarker string"),
    Relationship("JST_FOOTNOTE", "Verse", "JSTPassage", "footnoteMarker string"),
    Relationship("TG_SEE_ALSO", "TopicalGuideEntry", "TopicalGuideEntry"),
    Relationship("TG_BD_REF", "TopicalGuideEntry", "BibleDictEntry"),
    Relationship("TG_VERSE_REF", "TopicalGuideEntry", "Verse", "phrase string"),
    Relationship("BD_SEE_ALSO", "BibleDictEntry", "BibleDictEntry"),
    Relationship("BD_VERSE_REF", "BibleDictEntry", "Verse", "targetEndVerseId string"),
    Relationship("IDX_SEE_ALSO", "IndexEntry", "IndexEntry"),
    Relationship("IDX_TG_REF", "IndexEntry", "TopicalGuideEntry"),
    Relationship("IDX_BD_REF", "IndexEntry", "BibleDictEntry"),
    Relationship("IDX_VERSE_REF", "IndexEntry", "Verse", "phrase string"),
    Relationship("COMPARES", "JSTPassage", "Verse"),
)

#: (label, field, edge type, target, whether the field follows edges backwards): the fixed names by which labels reach each other.
FIELDS = (
    ("Volume", "books", "CONTAINS", "Book", False),
    ("Book", "volume", "CONTAINS", "Volume", True),
    ("Book", "chapters", "CONTAINS", "Chapter", False),
    ("Chapter", "book", "CONTAINS", "Book", True),
    ("Chapter", "verses", "HAS_VERSE", "Verse", False),
    ("Chapter", "verseGroups", "HAS_GROUP", "VerseGroup", False),
    ("VerseGroup", "chapter", "HAS_GROUP", "Chapter", True),
    ("VerseGroup", "verses", "INCLUDES", "Verse", False),
    ("Verse", "chapter", "HAS_VERSE", "Chapter", True),
    ("Verse", "crossRefsOut", "CROSS_REF", "Verse", False),
    ("Verse", "crossRefsIn", "CROSS_REF", "Verse", True),
    ("Verse", "tgFootnotes", "TG_FOOTNOTE", "TopicalGuideEntry", False),
    ("Verse", "bdFootnotes", "BD_FOOTNOTE", "BibleDictEntry", False),
    ("Verse", "jstFootnotes", "JST_FOOTNOTE", "JSTPassage", False),
    ("TopicalGuideEntry", "seeAlso", "TG_SEE_ALSO", "TopicalGuideEntry", False),
    ("TopicalGuideEntry", "bdRefs", "TG_BD_REF", "BibleDictEntry", False),
    ("TopicalGuideEntry", "verseRefs", "TG_VERSE_REF", "Verse", False),
    ("BibleDictEntry", "seeAlso", "BD_SEE_ALSO", "BibleDictEntry", False),
    ("BibleDictEntry", "verseRefs", "BD_VERSE_REF", "Verse", False),
    ("IndexEntry", "seeAlso", "IDX_SEE_ALSO", "IndexEntry", False),
    ("IndexEntry", "tgRefs", "IDX_TG_REF", "TopicalGuideEntry", False),
    ("IndexEntry", "bdRefs", "IDX_BD_REF", "BibleDictEntry", False),
    ("IndexEntry", "verseRefs", "IDX_VERSE_REF", "Verse", False),
    ("JSTPassage", "compareVerses", "COMPARES", "Verse", False),
)


CHAPTER_FILE = (
    "url string, book string, chapter int, summary string, verses array<struct<number:int,text:string,footnote_markers:array<string>>>, "
    "footnotes map<string,struct<category:string,reference_text:string,text:string>>"
)
ENTRY_LIST = "array<struct<phrase:string,reference:string,key:string>>"
DICTIONARY_ENTRY = "struct<text:string,references:array<string>>"
TRANSLATION = "reference string, book string, chapter string, entries array<struct<comprises:string,compare:string,summary:string,verses:array<struct<number:int,text:string>>>>"

METADATA = (
    "struct<startVerseNumber:int,endVerseNumber:int,chapterID:string,chapterNumber:int,url:string,book:string,chapter:string,"
    "comprises:string,compareRef:string,summary:string,verseNumber:int,reference:string>"
)
SEARCH_RESULT = f"entity_type string, id string, name string, text string, distance double, metadata {METADATA}"
