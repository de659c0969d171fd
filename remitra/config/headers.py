"""Where each canonical column is found in a bulk extract."""

from __future__ import annotations

# Header wording (lower case, single spaces), Lao and English, to column.
HEADER_MAP = {
    "ທະນາຄານ": "Banks", "bank": "Banks", "banks": "Banks",
    "ຜູ້ໃຊ້ງານ": "Users", "user": "Users", "users": "Users",
    "ວັນເດືອນປີ ເຮັດທຸລະກຳ": "Date_of_Transaction", "date of transaction": "Date_of_Transaction",
    "ວັນເດືອນປີ ສົ່ງຂໍ້ມູນ": "Date_of_Submission", "date of submission": "Date_of_Submission",
    "ເລກທີ່ໃບອ້າງອີງ": "Reference_Number", "reference number": "Reference_Number",
    "ລະຫັດຂອງຜູ້ໂອນ": "Transferor_Code", "transferor code": "Transferor_Code",
    "ຊື່ຜູ້ໂອນ": "Transferor_Name", "transferor name": "Transferor_Name",
    "ທີ່ຢູ່ຜູ້ໂອນ": "Transferor_Address", "transferor address": "Transferor_Address",
    "ເບີໂທຕິດຕໍ່ຜູ້ໂອນ": "Transferor_Contact_Number",
    "transferor contact number": "Transferor_Contact_Number",
    "ເລກວິສະຫະກິດຜູ້ໂອນ": "Transferor_Business_Number",
    "transferor business number": "Transferor_Business_Number",
    "ເລກປະຈຳຕົວຜູ້ເສຍອາກອນຜູ້ໂອນ": "Transferor_TIN", "transferor tin": "Transferor_TIN",
    "ຊື່ ແລະ ເລກບັນຊີຜູ້ໂອນ": "TransferorName_AccountNumber",
    "ລະຫັດຜູ້ຮັບ": "Recipient_Code", "recipient code": "Recipient_Code",
    "ຊື່ຜູ້ຮັບ": "Recipient_Name", "recipient name": "Recipient_Name",
    "ທີ່ຢູ່ຜູ້ຮັບ": "Recipient_Address", "recipient address": "Recipient_Address",
    "ເບີໂທຕິດຕໍ່ຜູ້ຮັບ": "Recipient_Contact_Number",
    "recipient contact number": "Recipient_Contact_Number",
    "ເລກວິສະຫະກິດຜູ້ຮັບ": "Recipient_Business_Number",
    "recipient business number": "Recipient_Business_Number",
    "ເລກປະຈຳຕົວຜູ້ເສຍອາກອນຜູ້ຮັບ": "Recipient_TIN", "recipient tin": "Recipient_TIN",
    "ຊື່ ແລະ ເລກບັນຊີຜູ້ຮັບ": "RecipientName_ AccountNumber",
    "ເອກະສານປະກອບ": "Supporting_Documents", "supporting documents": "Supporting_Documents",
    "ເລກທີເອກະສານປະກອບ": "Document_Number", "document number": "Document_Number",
    "ໃບອານຸຍາດຈາກ ທຫລ": "BOL_License", "bol license": "BOL_License",
    "ຄວາມສຳພັນຕໍ່ຜູ້ຮັບ": "Relationship_Recipient",
    "relationship recipient": "Relationship_Recipient",
    "ລະຫັດ lsic": "LSIC_Code", "lsic": "LSIC_Code", "lsic code": "LSIC_Code",
    "ລະຫັດຈຸດປະສົງ": "Purpose_Code", "purpose code": "Purpose_Code",
    "ຊື່ຈຸດປະສົງ": "Purpose_Name", "purpose name": "Purpose_Name",
    "ລະຫັດປະເທດ": "Country_Code", "country code": "Country_Code",
    "ວິທີການໂອນ": "Transfer_Method", "transfer method": "Transfer_Method",
    "ລະຫັດສະກຸນເງິນ": "Currency_Code", "currency code": "Currency_Code",
    "ຈຳນວນເງິນທີ່ໂອນ": "Amount_Transferred", "amount transferred": "Amount_Transferred",
    "ອັດຕາແລກປ່ຽນເປັນກີບ": "Exchange_Rates_Kip", "exchange rate kip": "Exchange_Rates_Kip",
    "ຈຳນວນເງິນເປັນກີບ": "Amount_Kip", "amount kip": "Amount_Kip",
    "ອັດຕາແລກປ່ຽນເປັນໂດລາ": "Exchange_Rates_USD", "exchange rate usd": "Exchange_Rates_USD",
    "ຈຳນວນເງີນເປັນໂດລາ": "Amount_USD", "ຈຳນວນເງິນເປັນໂດລາ": "Amount_USD",
    "amount usd": "Amount_USD",
    "ຄ່າທຳນຽມການໂອນ": "Transfer_Fee", "transfer fee": "Transfer_Fee",
    "ຂໍ້ມູນເພີ່ມເຕີມ": "Additional_Information",
    "additional information": "Additional_Information",
}
HEADER_ROWS = 6
HEADER_MIN_COLUMNS = 6

# Positions in the positional workbook, first those both sheets share.
COMMON_POSITIONS = {
    0: "Banks", 1: "Users", 2: "Date_of_Transaction", 3: "Date_of_Submission",
    4: "Reference_Number", 5: "Transferor_Code", 6: "Transferor_Name",
    12: "Purpose_Code", 13: "Country_Code", 14: "Transfer_Method", 15: "Currency_Code",
    16: "Amount_Transferred", 17: "Exchange_Rates_Kip", 18: "Amount_Kip",
    19: "Exchange_Rates_USD", 21: "Transfer_Fee", 22: "Additional_Information",
    23: "Code_New_Confirm", 24: "Pur_2", 25: "Amount_USD", 26: "M2", 27: "Use",
}
SHEET_POSITIONS = {
    "Recieve": {
        7: "Recipient_Code", 8: "Recipient_Name", 9: "Recipient_Contact_Number",
        10: "RecipientName_ AccountNumber", 11: "LSIC_Code",
    },
    "Payment": {
        7: "Transferor_Contact_Number", 8: "TransferorName_AccountNumber",
        9: "LSIC_Code", 10: "Recipient_Code", 11: "Recipient_Name",
    },
}
SHEET_FLOW = {"Recieve": "Receive", "Payment": "Payment"}

# File-name patterns that tell the direction, the bank cell of a template row.
FILE_FLOW = [
    (r"^money_transfer_in_detail_.*\.xlsx$", "Receive"),
    (r"^money_transfer_out_detail_.*\.xlsx$", "Payment"),
]
TEMPLATE_BANK = "format"
