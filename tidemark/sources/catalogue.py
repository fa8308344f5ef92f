"""A static catalogue of demonstration products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name, category, unit, description and file name of the picture: fixed values.
PRODUCTS = (
    ("Minyak Goreng 1L", "Sembako", "botol", "Minyak goreng sawit kemasan botol 1 liter untuk menumis dan menggoreng.", "minyak-goreng-1l"),
    ("Beras Premium 5kg", "Sembako", "karung", "Beras putih premium karung 5 kg, pulen untuk nasi harian.", "beras-premium-5kg"),
    ("Gula Pasir 1kg", "Sembako", "pak", "Gula pasir kristal putih kemasan 1 kg untuk masak dan minuman.", "gula-pasir-1kg"),
    ("Kopi Bubuk 200g", "Minuman", "pak", "Kopi robusta bubuk kemasan 200 gram, sangrai sedang.", "kopi-bubuk-200g"),
    ("Teh Celup 25 Kantong", "Minuman", "kotak", "Teh hitam celup isi 25 kantong, seduh cepat dan wangi.", "teh-celup-25"),
    ("Mie Instan Goreng 85g", "Sembako", "pak", "Mie instan goreng kemasan 85 gram dengan bumbu lengkap.", "mie-instan-goreng-85g"),
    ("Susu UHT Full Cream 1L", "Minuman", "karton", "Susu sapi UHT full cream karton 1 liter, siap minum.", "susu-uht-1l"),
    ("Telur Ayam Negeri 1kg", "Sembako", "kg", "Telur ayam negeri segar kemasan 1 kg, sekitar 16 butir.", "telur-ayam-1kg"),
    ("Sabun Mandi Batang 80g", "Perawatan", "batang", "Sabun mandi batang 80 gram, busa lembut dan wangi segar.", "sabun-mandi-80g"),
    ("Shampo Anti Ketombe 170ml", "Perawatan", "botol", "Shampo anti ketombe botol 170 ml dengan sensasi mentol.", "shampo-170ml"),
)
IMAGES = "/images/demo-products"


def products(spark: SparkSession) -> DataFrame:
    """product_name, category, unit, description, image_url; ``sales.enrich`` looks names up in it."""
    rows = [(name, category, unit, text, f"{IMAGES}/{slug}.svg") for name, category, unit, text, slug in PRODUCTS]
    return spark.createDataFrame(rows, "product_name string, category string, unit string, description string, image_url string")
