"""Entity labels: published source labels, the shared taxonomy, and maps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Published label sets and their normalised types.
OPENPII_LABELS = "AGE BUILDINGNUM CITY CREDITCARDNUMBER DATE DRIVERLICENSENUM EMAIL GENDER GIVENNAME IDCARDNUM PASSPORTNUM SEX SOCIALNUM STREET SURNAME TAXNUM TELEPHONENUM TITLE ZIPCODE".split()
GRETEL_LABELS = "ACCOUNT_PIN API_KEY BANK_ROUTING_NUMBER BBAN COMPANY CREDIT_CARD_NUMBER CREDIT_CARD_SECURITY_CODE CUSTOMER_ID DATE DATE_OF_BIRTH DATE_TIME DRIVER_LICENSE_NUMBER EMAIL EMPLOYEE_ID FIRST_NAME IBAN IPV4 IPV6 LAST_NAME LOCAL_LATLNG NAME PASSPORT_NUMBER PASSWORD PHONE_NUMBER SSN STREET_ADDRESS SWIFT_BIC_CODE TIME USER_NAME".split()
TYPES = "ADDRESS AGE BANK_ACCOUNT BANK_ROUTING_NUMBER CITY COMPANY CREDIT_CARD DATE DATE_TIME DRIVER_LICENSE EMAIL GENDER ID_NUMBER IP_ADDRESS LOCATION PASSPORT PASSWORD PERSON PHONE POSTAL_CODE SECRET SOCIAL_SECURITY_NUMBER SWIFT_CODE TAX_ID TIME TITLE USERNAME".split()
LABELS = {
    "PERSON": "PERSON", "NAME": "PERSON", "FULL_NAME": "PERSON", "FIRST_NAME": "PERSON", "LAST_NAME": "PERSON", "GIVENNAME": "PERSON", "SURNAME": "PERSON",
    "AGE": "AGE", "GENDER": "GENDER", "SEX": "GENDER", "TITLE": "TITLE",
    "EMAIL": "EMAIL", "EMAIL_ADDRESS": "EMAIL", "PHONE": "PHONE", "PHONE_NUMBER": "PHONE", "TELEPHONE": "PHONE", "TELEPHONENUM": "PHONE",
    "ADDRESS": "ADDRESS", "STREET": "ADDRESS", "STREET_ADDRESS": "ADDRESS", "BUILDINGNUM": "ADDRESS", "CITY": "CITY", "LOCATION": "LOCATION", "LOCAL_LATLNG": "LOCATION",
    "POSTAL_CODE": "POSTAL_CODE", "ZIP_CODE": "POSTAL_CODE", "ZIPCODE": "POSTAL_CODE",
    "DATE": "DATE", "DATE_OF_BIRTH": "DATE", "DOB": "DATE", "DATE_TIME": "DATE_TIME", "TIME": "TIME",
    "ID": "ID_NUMBER", "ID_NUMBER": "ID_NUMBER", "IDCARDNUM": "ID_NUMBER", "CUSTOMER_ID": "ID_NUMBER", "EMPLOYEE_ID": "ID_NUMBER",
    "PASSPORT": "PASSPORT", "PASSPORT_NUMBER": "PASSPORT", "PASSPORTNUM": "PASSPORT",
    "DRIVER_LICENSE": "DRIVER_LICENSE", "DRIVERS_LICENSE": "DRIVER_LICENSE", "DRIVER_LICENSE_NUMBER": "DRIVER_LICENSE", "DRIVERLICENSENUM": "DRIVER_LICENSE",
    "TAX_ID": "TAX_ID", "TAXNUM": "TAX_ID", "SSN": "SOCIAL_SECURITY_NUMBER", "SOCIALNUM": "SOCIAL_SECURITY_NUMBER",
    "CREDIT_CARD": "CREDIT_CARD", "CREDIT_CARD_NUMBER": "CREDIT_CARD", "CREDITCARDNUMBER": "CREDIT_CARD",
    "BANK_ACCOUNT": "BANK_ACCOUNT", "ACCOUNT_NUMBER": "BANK_ACCOUNT", "BBAN": "BANK_ACCOUNT", "IBAN": "BANK_ACCOUNT", "BANK_ROUTING_NUMBER": "BANK_ROUTING_NUMBER", "SWIFT_BIC_CODE": "SWIFT_CODE",
    "IP": "IP_ADDRESS", "IP_ADDRESS": "IP_ADDRESS", "IPV4": "IP_ADDRESS", "IPV6": "IP_ADDRESS", "USERNAME": "USERNAME", "USER_NAME": "USERNAME", "PASSWORD": "PASSWORD",
    "API_KEY": "SECRET", "ACCOUNT_PIN": "SECRET", "CREDIT_CARD_SECURITY_CODE": "SECRET", "COMPANY": "COMPANY", "ORGANIZATION": "COMPANY",
}
MASKING_LABELS = {
    "ACCOUNTNUMBER": "BANK_ACCOUNT", "BIC": "SWIFT_CODE", "BUILDINGNUMBER": "ADDRESS", "COMPANYNAME": "COMPANY", "CREDITCARDCVV": "SECRET", "CREDITCARDNUMBER": "CREDIT_CARD",
    "DOB": "DATE", "EMAIL": "EMAIL", "FIRSTNAME": "PERSON", "IBAN": "BANK_ACCOUNT", "IP": "IP_ADDRESS", "IPV4": "IP_ADDRESS", "IPV6": "IP_ADDRESS", "JOBTITLE": "TITLE",
    "LASTNAME": "PERSON", "MASKEDNUMBER": "ID_NUMBER", "MIDDLENAME": "PERSON", "NEARBYGPSCOORDINATE": "LOCATION", "PASSWORD": "PASSWORD", "PHONENUMBER": "PHONE", "PHONEIMEI": "ID_NUMBER",
    "PIN": "SECRET", "SECONDARYADDRESS": "ADDRESS", "SSN": "SOCIAL_SECURITY_NUMBER", "STREET": "ADDRESS", "USERNAME": "USERNAME", "VEHICLEVIN": "ID_NUMBER", "VEHICLEVRM": "ID_NUMBER", "ZIPCODE": "POSTAL_CODE",
}
MASKING_IGNORED = "ACCOUNTNAME AGE AMOUNT BITCOINADDRESS CITY COUNTY CREDITCARDISSUER CURRENCY CURRENCYCODE CURRENCYNAME CURRENCYSYMBOL DATE ETHEREUMADDRESS EYECOLOR GENDER HEIGHT JOBAREA JOBTYPE LITECOINADDRESS MAC ORDINALDIRECTION PREFIX SEX STATE TIME URL USERAGENT".split()


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """The value of ``key`` in a small fixed map; null if it has none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)), key)


def normalized_label(label: Column, mapping: dict[str, str] | None = None) -> Column:
    """The shared type of a source label: case, outer blanks, hyphens and blanks ignored; null if unknown."""
    key = F.upper(F.translate(F.trim(label), "- ", "__"))
    return lookup(mapping or LABELS, key)


def audit_labels(spark: SparkSession, sources: dict[str, list[str]], mapping: dict[str, str] | None = None, types: list[str] | None = None) -> DataFrame:
    """``source, kind, label`` of source labels without a mapping (missing) and of targets outside the taxonomy (invalid)."""
    have = spark.createDataFrame([(s, x) for s, labels in sources.items() for x in labels], "source string, label string")
    to = spark.createDataFrame(list((mapping or LABELS).items()), "label string, target string")
    known = spark.createDataFrame([(t,) for t in types or TYPES], "target string")
    missing = have.join(to, "label", "left_anti").select("source", F.lit("missing").alias("kind"), "label")
    invalid = have.join(to, "label").join(known, "target", "left_anti").select("source", F.lit("invalid").alias("kind"), F.col("target").alias("label")).distinct()
    return missing.unionByName(invalid)
