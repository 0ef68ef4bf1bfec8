"""Shared test constants: folders of the driver tables and small feed documents."""

SF_SMALL = "/root/testdata/sf0.001"

FEED_GOOD = """<rss xmlns:ht="https://example.org/ht" version="2.0"><channel>
 <item><title>a &amp; b</title><ht:approx_traffic>200K+</ht:approx_traffic>
  <description><![CDATA[x <b>y</b>]]></description><link>http://l/1</link>
  <pubDate>Tue, 2 Dec 2025 06:10:00 -0800</pubDate><ht:picture>http://p/1.jpg</ht:picture>
  <ht:news_item><ht:news_item_title>n1</ht:news_item_title><ht:news_item_snippet/>
   <ht:news_item_url>https://News.Example.RU:8080/a</ht:news_item_url><ht:news_item_source>S</ht:news_item_source></ht:news_item>
 </item>
 <item><title>c</title><ht:approx_traffic>2M+</ht:approx_traffic><pubDate>Wed, 3 Dec 2025 01:00:00 +0000</pubDate>
  <ht:news_item><ht:news_item_title>n2</ht:news_item_title>
   <ht:news_item_url>https://b.com/a</ht:news_item_url><ht:news_item_source>S2</ht:news_item_source></ht:news_item>
  <ht:news_item><ht:news_item_title>n3</ht:news_item_title>
   <ht:news_item_url>https://c.org/a</ht:news_item_url><ht:news_item_source>S3</ht:news_item_source></ht:news_item>
 </item>
 <item><title>d</title><ht:approx_traffic>5K+</ht:approx_traffic><pubDate>bad</pubDate></item>
 <item><title>c</title><ht:approx_traffic>9K+</ht:approx_traffic><pubDate>Wed, 3 Dec 2025 01:00:00 +0000</pubDate></item>
</channel></rss>
"""
FEED_NO_NS = '<rss version="2.0"><channel><item><title>x</title></item></channel></rss>'
FEED_BAD = '<rss xmlns:ht="u"><channel><item><title>x</title></channel></rss>'
FEED_EMPTY = '<rss xmlns:ht="u"><channel></channel></rss>'
FEED_LATER = """<rss xmlns:ht="https://example.org/ht" version="2.0"><channel>
 <item><title>e</title><ht:approx_traffic>50K+</ht:approx_traffic><pubDate>Thu, 4 Dec 2025 01:00:00 GMT</pubDate></item>
 <item><title>a &amp; b</title><ht:approx_traffic>200K+</ht:approx_traffic><pubDate>Tue, 2 Dec 2025 06:10:00 -0800</pubDate></item>
</channel></rss>
"""
