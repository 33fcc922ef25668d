from foliant.sources import catalogs


def rows(df):
    return sorted((r.ext_id, r.title, r.author, r.year, r.language, r.isbn, r.href) for r in df.collect())


def test_json(spark):
    df = lambda *x: spark.createDataFrame([(v,) for v in x], "json string")
    search = '{"docs":[{"key":"/w/1","title":"Emma","author_name":["Jane Austen","X"],"first_publish_year":1815,"language":["eng"],"isbn":["123","9780141439587"]},{"key":"/w/2","title":" "}]}'
    assert rows(catalogs.from_search(df(search, "{broken", None))) == [("/w/1", "Emma", "Jane Austen, X", "1815", "en", "9780141439587", None)]
    assert rows(catalogs.from_subject(df('{"works":[{"key":"k","title":"T","authors":[{"name":"A"},{"name":"B"}],"first_publish_year":1900}]}'))) == [("k", "T", "A, B", "1900", None, None, None)]
    assert rows(catalogs.from_volumes(df('{"items":[{"id":"i","volumeInfo":{"title":"T","subtitle":"S","authors":["A"],"publishedDate":"2001-05","language":"fr","infoLink":"h","industryIdentifiers":[{"type":"ISBN_10","identifier":"0306406152"}]}}]}'))) == [("i", "T: S", "A", "2001", "fr", "0306406152", "h")]
    assert rows(catalogs.from_store(df('{"results":[{"trackId":7,"trackName":"T","artistName":"A","releaseDate":"1999-01-01","trackViewUrl":"u"}]}'))) == [("7", "T", "A", "1999", None, None, "u")]


def test_feeds(spark):
    atom = """<feed><entry><id>1</id><title>A &amp; B</title><author><name>X Y</name></author><author><name>Z</name></author><dc:issued>1920</dc:issued><dc:language>ger</dc:language><link href="p.epub" rel="http://opds-spec.org/acquisition"/></entry><entry><title></title></entry></feed>"""
    assert rows(catalogs.from_atom(spark.createDataFrame([(atom,)], "xml string"))) == [("1", "A & B", "X Y, Z", "1920", "de", None, "p.epub")]
    rss = "<rss><channel><item><title><![CDATA[T <b>1</b>]]></title><book_id>5</book_id><author_name>A</author_name><book_published>1950</book_published><isbn>9780306406157</isbn><link>l</link></item><item><title>T 1</title><book_id>5</book_id></item></channel></rss>"
    got = rows(catalogs.from_rss(spark.createDataFrame([(rss,)], "xml string")))
    assert len(got) == 1 and got[0][0] == "5"
    table = spark.createDataFrame([("eng", "kjv", "King", "True"), ("eng", "x", "Y", "False")], "languageCode string, translationId string, title string, Redistributable string")
    assert rows(catalogs.from_bible_list(table)) == [("kjv", "King", None, None, "en", None, None)]


def test_merge_and_places(spark):
    schema = "source string, ext_id string, title string, author string, year string, language string, isbn string, href string"
    data = [("a", "1", "Emma", "J", "1815", None, None, None), ("b", "2", "EMMA!", "j", "1815", "en", None, None), ("a", "3", "X", None, None, None, "111", None), ("c", "4", "Y", "Q", None, None, "111", None)]
    assert sorted(r.ext_id for r in catalogs.merged(spark.createDataFrame(data, schema)).collect()) == ["2", "4"]
    names = spark.createDataFrame([("The city of Ur",), ("Jordan River",), ("Nowhere",), ("Ur",)], "name string")
    gaz = spark.createDataFrame([("Ur", 30.9, 46.1), ("Jordan", 32.0, 35.5)], "place string, lat double, lon double")
    assert sorted((r.name, r.place) for r in catalogs.places(names, gaz).collect()) == [("Jordan River", "Jordan"), ("Nowhere", None), ("The city of Ur", "Ur"), ("Ur", "Ur")]
