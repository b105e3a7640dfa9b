"""Declared schemas of the clinical tables, so that no read infers types from the data."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and types of the tables, as DDL.
TABLES = {
    "PATIENTS": "SUBJECT_ID int, GENDER string, DOB timestamp, DOD timestamp, DOD_HOSP timestamp,"
                " DOD_SSN timestamp, EXPIRE_FLAG int",
    "ADMISSIONS": "SUBJECT_ID int, HADM_ID int, ADMITTIME timestamp, DISCHTIME timestamp, DEATHTIME timestamp,"
                  " ADMISSION_TYPE string, ADMISSION_LOCATION string, INSURANCE string, LANGUAGE string,"
                  " RELIGION string, MARITAL_STATUS string, ETHNICITY string, EDREGTIME timestamp,"
                  " EDOUTTIME timestamp, DIAGNOSIS string, HOSPITAL_EXPIRE_FLAG int, HAS_CHARTEVENTS_DATA int",
    "ICUSTAYS": "SUBJECT_ID int, HADM_ID int, ICUSTAY_ID int, DBSOURCE string, FIRST_CAREUNIT string,"
                " LAST_CAREUNIT string, FIRST_WARDID int, LAST_WARDID int, INTIME timestamp, OUTTIME timestamp,"
                " LOS double",
    "CHARTEVENTS": "SUBJECT_ID int, HADM_ID int, ICUSTAY_ID int, ITEMID int, CHARTTIME timestamp,"
                   " STORETIME timestamp, CGID int, VALUE string, VALUENUM double, VALUEUOM string, WARNING int,"
                   " ERROR int, RESULTSTATUS string, STOPPED string",
    "DATETIMEEVENTS": "SUBJECT_ID int, HADM_ID int, ICUSTAY_ID int, ITEMID int, CHARTTIME timestamp,"
                      " STORETIME timestamp, CGID int, VALUE timestamp, VALUEUOM string, WARNING int, ERROR int,"
                      " RESULTSTATUS string, STOPPED string",
    "LABEVENTS": "SUBJECT_ID int, HADM_ID int, ITEMID int, CHARTTIME timestamp, VALUE string, VALUENUM double,"
                 " VALUEUOM string, FLAG string",
    "OUTPUTEVENTS": "SUBJECT_ID int, HADM_ID int, ICUSTAY_ID int, CHARTTIME timestamp, ITEMID int, VALUE double,"
                    " VALUEUOM string, STORETIME timestamp, CGID int, STOPPED string, NEWBOTTLE string, ISERROR int",
    "INPUTEVENTS_MV": "SUBJECT_ID int, HADM_ID int, ICUSTAY_ID int, STARTTIME timestamp, ENDTIME timestamp,"
                      " ITEMID int, AMOUNT double, AMOUNTUOM string, RATE double, RATEUOM string, ORDERID int,"
                      " LINKORDERID int, ORDERCATEGORYNAME string, ORDERCOMPONENTTYPEDESCRIPTION string,"
                      " PATIENTWEIGHT double, TOTALAMOUNT double, STATUSDESCRIPTION string, ORIGINALRATE double",
    "INPUTEVENTS_CV": "SUBJECT_ID int, HADM_ID int, ICUSTAY_ID int, CHARTTIME timestamp, ITEMID int,"
                      " AMOUNT double, AMOUNTUOM string, RATE double, RATEUOM string, ORDERID int,"
                      " LINKORDERID int, STOPPED string, NEWBOTTLE string",
    "D_ITEMS": "ITEMID int, LABEL string, ABBREVIATION string, DBSOURCE string, LINKSTO string, CATEGORY string,"
               " UNITNAME string, PARAM_TYPE string",
    "D_LABITEMS": "ITEMID int, LABEL string, FLUID string, CATEGORY string, LOINC_CODE string",
    "TRANSFERS": "SUBJECT_ID int, HADM_ID int, ICUSTAY_ID int, EVENTTYPE string, PREV_CAREUNIT string,"
                 " CURR_CAREUNIT string, INTIME timestamp, OUTTIME timestamp, LOS double",
    "SERVICES": "SUBJECT_ID int, HADM_ID int, TRANSFERTIME timestamp, PREV_SERVICE string, CURR_SERVICE string",
    "CALLOUT": "SUBJECT_ID int, HADM_ID int, CURR_CAREUNIT string, CREATETIME timestamp, OUTCOMETIME timestamp,"
               " CALLOUT_OUTCOME string",
    "PROCEDUREEVENTS_MV": "SUBJECT_ID int, HADM_ID int, ICUSTAY_ID int, STARTTIME timestamp, ENDTIME timestamp,"
                          " ITEMID int, VALUE double, VALUEUOM string, ORDERCATEGORYNAME string",
    "NOTEEVENTS": "SUBJECT_ID int, HADM_ID int, CHARTDATE timestamp, CHARTTIME timestamp, CATEGORY string,"
                  " DESCRIPTION string, CGID int, ISERROR int, TEXT string",
    "CAREGIVERS": "CGID int, LABEL string, DESCRIPTION string",
    "MICROBIOLOGYEVENTS": "SUBJECT_ID int, HADM_ID int, CHARTDATE timestamp, CHARTTIME timestamp,"
                          " SPEC_TYPE_DESC string, ORG_NAME string, AB_NAME string, INTERPRETATION string",
    "PRESCRIPTIONS": "SUBJECT_ID int, HADM_ID int, ICUSTAY_ID int, STARTDATE timestamp, ENDDATE timestamp,"
                     " DRUG_TYPE string, DRUG string, ROUTE string",
    "DIAGNOSES_ICD": "SUBJECT_ID int, HADM_ID int, SEQ_NUM int, ICD9_CODE string",
    "PROCEDURES_ICD": "SUBJECT_ID int, HADM_ID int, SEQ_NUM int, ICD9_CODE string",
    "D_ICD_DIAGNOSES": "ICD9_CODE string, SHORT_TITLE string, LONG_TITLE string",
    "D_ICD_PROCEDURES": "ICD9_CODE string, SHORT_TITLE string, LONG_TITLE string",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])
