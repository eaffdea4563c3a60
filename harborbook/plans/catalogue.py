"""Rating fields: where each number sits in the rating and quote documents.

Fixed values: names, paths, types and defaults must be exactly these for right results.
"""

from harborbook.functions import JsonField

RATING_MASTER_FIELDS = (
    JsonField("blanket_equip_occ_lim", "quote_package_data", ("coverages", "BASE", "subCoverages", "BLANKET_EQUIPMENT", "limits", "OCCURRENCE"), "decimal(18,0)", inner=2),
    JsonField("blanket_equip_ded", "quote_package_data", ("coverages", "BASE", "subCoverages", "BLANKET_EQUIPMENT", "limits", "DEDUCTIBLE"), "decimal(18,0)", inner=2),
    JsonField("blanket_factor", "calculation", ("basePremiumCalculation", "blanketEquipmentPremiumCalculation", "blanketFactor"), "decimal(10,4)", "1.5"),
    JsonField("ded_factor", "calculation", ("basePremiumCalculation", "blanketEquipmentPremiumCalculation", "deductibleFactor"), "decimal(10,4)", "1"),
    JsonField("base_premium_loss_cost", "calculation", ("basePremiumCalculation", "blanketEquipmentPremiumCalculation", "lossCost"), "decimal(10,4)", "2.67"),
    JsonField("base_premium_lcm", "calculation", ("basePremiumCalculation", "blanketEquipmentPremiumCalculation", "lcm"), "decimal(10,4)", "2"),
    JsonField("loss_cost_10k", "calculation", ("basePremiumCalculation", "blanketEquipmentPremiumCalculation", "lossCostOver10K"), "decimal(10,4)", "1.84"),
    JsonField("rewards_coverage_prem", "calculation", ("additionalCoverageCalculation", "f1 <- rewardsCoverage"), "decimal(18,0)"),
    JsonField("rewards_coverage_delta", "calculation", ("additionalCoverageCalculation", "rewardsCoverageCalclog", "limitDelta"), "decimal(18,0)"),
    JsonField("rewards_coverage_lcm", "calculation", ("additionalCoverageCalculation", "rewardsCoverageCalclog", "lcm"), "decimal(10,4)"),
    JsonField("reward_coverage_loss_cost", "calculation", ("additionalCoverageCalculation", "rewardsCoverageCalclog", "lossCostValue"), "decimal(10,4)", "0.08", split=True),
    JsonField("rewards_coverage_package_lim", "quote_package_data", ("coverages", "ADDITIONAL_COVERAGE", "subCoverages", "REWARDS", "limits", "OCCURRENCE"), "decimal(18,0)", inner=2),
    JsonField("rewards_coverage_base_lim", "calculation", ("additionalCoverageCalculation", "rewardsCoverageCalclog", "limitDeltaCalclog", "baseLimitValue"), "decimal(18,0)"),
    JsonField("debris_removal_prem", "calculation", ("additionalCoverageCalculation", "f2 <- debrisRemoval"), "decimal(18,0)"),
    JsonField("debris_removal_delta", "calculation", ("additionalCoverageCalculation", "debrisRemovalCalclog", "limitDelta"), "decimal(18,0)"),
    JsonField("debris_removal_lcm", "calculation", ("additionalCoverageCalculation", "debrisRemovalCalclog", "lcm"), "decimal(10,4)"),
    JsonField("debris_removal_loss_cost", "calculation", ("additionalCoverageCalculation", "debrisRemovalCalclog", "lossCostValue"), "decimal(10,4)", "0.01", split=True),
    JsonField("debris_removal_package_lim", "quote_package_data", ("coverages", "ADDITIONAL_COVERAGE", "subCoverages", "DEBRIS_REMOVAL", "limits", "DEBRIS_REMOVAL"), "decimal(18,0)", inner=2),
    JsonField("debris_removal_base_lim", "calculation", ("additionalCoverageCalculation", "debrisRemovalCalclog", "limitDeltaCalclog", "baseLimitValue"), "decimal(18,0)"),
    JsonField("false_pretense_prem", "calculation", ("additionalCoverageCalculation", "f3 <- falsePretense"), "decimal(18,0)"),
    JsonField("false_pretense_delta", "calculation", ("additionalCoverageCalculation", "falsePretenseCalclog", "limitDelta"), "decimal(18,0)"),
    JsonField("false_pretense_lcm", "calculation", ("additionalCoverageCalculation", "falsePretenseCalclog", "lcm"), "decimal(10,4)"),
    JsonField("false_pretense_loss_cost", "calculation", ("additionalCoverageCalculation", "falsePretenseCalclog", "lossCostValue"), "decimal(10,4)", "0.05", split=True),
    JsonField("false_pretense_package_lim", "quote_package_data", ("coverages", "ADDITIONAL_COVERAGE", "subCoverages", "FALSE_PRETENSE", "limits", "OCCURRENCE"), "decimal(18,0)", inner=2),
    JsonField("false_pretense_base_lim", "calculation", ("additionalCoverageCalculation", "falsePretenseCalclog", "limitDeltaCalclog", "baseLimitValue"), "decimal(18,0)"),
    JsonField("fire_dept_prem", "calculation", ("additionalCoverageCalculation", "f4 <- fireDepartmentService"), "decimal(18,0)"),
    JsonField("fire_dept_delta", "calculation", ("additionalCoverageCalculation", "fireDepartmentServiceCalclog", "limitDelta"), "decimal(18,0)"),
    JsonField("fire_dept_lcm", "calculation", ("additionalCoverageCalculation", "fireDepartmentServiceCalclog", "lcm"), "decimal(10,4)"),
    JsonField("fire_dept_loss_cost", "calculation", ("additionalCoverageCalculation", "fireDepartmentServiceCalclog", "lossCostValue"), "decimal(10,4)", "0.3", split=True),
    JsonField("fire_dept_package_lim", "quote_package_data", ("coverages", "ADDITIONAL_COVERAGE", "subCoverages", "FIRE_DEPARTMENT_SERVICE_CHARGE", "limits", "OCCURRENCE"), "decimal(18,0)", inner=2),
    JsonField("fire_dept_base_lim", "calculation", ("additionalCoverageCalculation", "fireDepartmentServiceCalclog", "limitDeltaCalclog", "baseLimitValue"), "decimal(18,0)"),
    JsonField("fire_extinguishing_service_prem", "calculation", ("additionalCoverageCalculation", "f5 <- fireExtinguishingSystems"), "decimal(18,0)"),
    JsonField("fire_extinguishing_service_delta", "calculation", ("additionalCoverageCalculation", "fireExtinguishingSystemsCalclog", "limitDelta"), "decimal(18,0)"),
    JsonField("fire_extinguishing_service_lcm", "calculation", ("additionalCoverageCalculation", "fireExtinguishingSystemsCalclog", "lcm"), "decimal(10,4)"),
    JsonField("fire_extinguishing_service_loss_cost", "calculation", ("additionalCoverageCalculation", "fireExtinguishingSystemsCalclog", "lossCostValue"), "decimal(10,4)", "0.05", split=True),
    JsonField("fire_extinguishing_service_package_lim", "quote_package_data", ("coverages", "ADDITIONAL_COVERAGE", "subCoverages", "FIRE_EXTINGUISHING_SYSTEMS_EXPENSE", "limits", "OCCURRENCE"), "decimal(18,0)", inner=2),
    JsonField("fire_extinguishing_service_base_lim", "calculation", ("additionalCoverageCalculation", "fireExtinguishingSystemsCalclog", "limitDeltaCalclog", "baseLimitValue"), "decimal(18,0)"),
    JsonField("fuel_accessory_parts_prem", "calculation", ("additionalCoverageCalculation", "f6 <- fuelAccessoriesSpareParts"), "decimal(18,0)"),
    JsonField("fuel_accessory_parts_delta", "calculation", ("additionalCoverageCalculation", "fuelAccessoriesSparePartsCalclog", "limitDelta"), "decimal(18,0)"),
    JsonField("fuel_accessory_parts_lcm", "calculation", ("additionalCoverageCalculation", "fuelAccessoriesSparePartsCalclog", "lcm"), "decimal(10,4)"),
    JsonField("fuel_accessory_parts_loss_cost", "calculation", ("additionalCoverageCalculation", "fuelAccessoriesSparePartsCalclog", "lossCostValue"), "decimal(10,4)", "0.25", split=True),
    JsonField("fuel_accessory_parts_package_lim", "quote_package_data", ("coverages", "ADDITIONAL_COVERAGE", "subCoverages", "FUEL_ACCESSORIES_AND_SPARE_PARTS", "limits", "OCCURRENCE"), "decimal(18,0)", inner=2),
    JsonField("fuel_accessory_parts_base_lim", "calculation", ("additionalCoverageCalculation", "fuelAccessoriesSparePartsCalclog", "limitDeltaCalclog", "baseLimitValue"), "decimal(18,0)"),
    JsonField("inventory_appraisal_prem", "calculation", ("additionalCoverageCalculation", "f7 <- inventoryAppraisal"), "decimal(18,0)"),
    JsonField("inventory_appraisal_delta", "calculation", ("additionalCoverageCalculation", "inventoryAppraisalCalclog", "limitDelta"), "decimal(18,0)"),
    JsonField("inventory_appraisal_lcm", "calculation", ("additionalCoverageCalculation", "inventoryAppraisalCalclog", "lcm"), "decimal(10,4)"),
    JsonField("inventory_appraisal_loss_cost", "calculation", ("additionalCoverageCalculation", "inventoryAppraisalCalclog", "lossCostValue"), "decimal(10,4)", "0.75", split=True),
    JsonField("inventory_appraisal_package_lim", "quote_package_data", ("coverages", "ADDITIONAL_COVERAGE", "subCoverages", "INVENTORY_AND_APPRAISAL_EXPENSE", "limits", "OCCURRENCE"), "decimal(18,0)", inner=2),
    JsonField("inventory_appraisal_base_lim", "calculation", ("additionalCoverageCalculation", "inventoryAppraisalCalclog", "limitDeltaCalclog", "baseLimitValue"), "decimal(18,0)"),
    JsonField("pollutant_removal_prem", "calculation", ("additionalCoverageCalculation", "f8 <- pollutantRemoval"), "decimal(18,0)"),
    JsonField("pollutant_removal_delta", "calculation", ("additionalCoverageCalculation", "pollutantRemovalCalclog", "limitDelta"), "decimal(18,0)"),
    JsonField("pollutant_removal_lcm", "calculation", ("additionalCoverageCalculation", "pollutantRemovalCalclog", "lcm"), "decimal(10,4)"),
    JsonField("pollutant_removal_loss_cost", "calculation", ("additionalCoverageCalculation", "pollutantRemovalCalclog", "lossCostValue"), "decimal(10,4)", "0.01", split=True),
    JsonField("pollutant_removal_package_lim", "quote_package_data", ("coverages", "ADDITIONAL_COVERAGE", "subCoverages", "POLLUTANT_CLEANUP_AND_REMOVAL", "limits", "AGGREGATE"), "decimal(18,0)", inner=2),
    JsonField("pollutant_removal_base_lim", "calculation", ("additionalCoverageCalculation", "pollutantRemovalCalclog", "limitDeltaCalclog", "baseLimitValue"), "decimal(18,0)"),
    JsonField("trailers_contents_prem", "calculation", ("additionalCoverageCalculation", "f9 <- trailersContents"), "decimal(18,0)"),
    JsonField("trailers_contents_delta", "calculation", ("additionalCoverageCalculation", "trailersContentsCalclog", "limitDelta"), "decimal(18,0)"),
    JsonField("trailers_contents_lcm", "calculation", ("additionalCoverageCalculation", "trailersContentsCalclog", "lcm"), "decimal(10,4)"),
    JsonField("trailers_contents_loss_cost", "calculation", ("additionalCoverageCalculation", "trailersContentsCalclog", "lossCostValue"), "decimal(10,4)", "0.25", split=True),
    JsonField("trailers_contents_package_lim", "quote_package_data", ("coverages", "ADDITIONAL_COVERAGE", "subCoverages", "TRAILERS_AND_CONTENTS", "limits", "OCCURRENCE"), "decimal(18,0)", inner=2),
    JsonField("trailers_contents_base_lim", "calculation", ("additionalCoverageCalculation", "trailersContentsCalclog", "limitDeltaCalclog", "baseLimitValue"), "decimal(18,0)"),
    JsonField("tools_clothes_prem", "calculation", ("additionalCoverageCalculation", "f10 <- employeeToolsClothingPremium"), "decimal(18,0)", "0"),
    JsonField("tools_clothes_emp_delta", "calculation", ("additionalCoverageCalculation", "employeeToolsClothingCalclog", "perEmployeeCalcLog", "limitDelta"), "decimal(18,0)", "0"),
    JsonField("tools_clothes_emp_lcm", "calculation", ("additionalCoverageCalculation", "employeeToolsClothingCalclog", "perEmployeeCalcLog", "lcm"), "decimal(10,4)"),
    JsonField("tools_clothes_emp_loss_cost", "calculation", ("additionalCoverageCalculation", "employeeToolsClothingCalclog", "perEmployeeCalcLog", "lossCostValue"), "decimal(10,4)", "0.01", split=True),
    JsonField("tools_clothes_emp_package_lim", "quote_package_data", ("coverages", "ADDITIONAL_COVERAGE", "subCoverages", "EMPLOYEE_TOOLS_AND_CLOTHING", "limits", "PER_EMPLOYEE"), "decimal(18,0)", inner=2),
    JsonField("tools_clothes_emp_base_lim", "calculation", ("additionalCoverageCalculation", "employeeToolsClothingCalclog", "perEmployeeCalcLog", "limitDeltaCalclog", "baseLimitValue"), "decimal(18,0)"),
    JsonField("tools_clothes_occ_rate", "calculation", ("additionalCoverageCalculation", "employeeToolsClothingCalclog", "perOccurrenceFinalRate"), "decimal(10,4)", "0.75"),
    JsonField("tools_clothes_occ_delta", "calculation", ("additionalCoverageCalculation", "employeeToolsClothingCalclog", "limitDelta"), "decimal(10,4)", "0"),
    JsonField("tools_clothes_occ_package_lim", "quote_package_data", ("coverages", "ADDITIONAL_COVERAGE", "subCoverages", "EMPLOYEE_TOOLS_AND_CLOTHING", "limits", "OCCURRENCE"), "decimal(18,0)", inner=2),
    JsonField("tools_clothes_occ_base_limit", "calculation", ("additionalCoverageCalculation", "employeeToolsClothingCalclog", "limitDeltaCalclog", "baseLimitValue"), "decimal(18,0)"),
    JsonField("borrowed_equip_prem", "calculation", ("optionalCoverageCalculation", "f1 <- borrowedEquipmentCoverage"), "decimal(18,0)"),
    JsonField("borrowed_equip_lcm", "calculation", ("optionalCoverageCalculation", "borrowedEquipmentCoverageCalclog", "lcm"), "decimal(10,4)"),
    JsonField("borrowed_equip_loss_cost", "calculation", ("optionalCoverageCalculation", "borrowedEquipmentCoverageCalclog", "lossCost"), "decimal(10,4)"),
    JsonField("borrowed_equip_lim", "quote_package_data", ("coverages", "OPTIONAL_COVERAGE", "subCoverages", "EQUIPMENT_BORROWED_FROM_OTHERS", "limits", "OCCURRENCE"), "decimal(18,0)", inner=2),
    JsonField("leased_from_prem", "calculation", ("optionalCoverageCalculation", "f2 <- leasedFromEquipmentCoverage"), "decimal(18,0)"),
    JsonField("leased_from_lcm", "calculation", ("optionalCoverageCalculation", "leasedFromEquipmentCoverageCalclog", "lcm"), "decimal(10,4)"),
    JsonField("leased_from_loss_cost", "calculation", ("optionalCoverageCalculation", "leasedFromEquipmentCoverageCalclog", "lossCost"), "decimal(10,4)"),
    JsonField("leased_from_lim", "calculation", ("optionalCoverageCalculation", "leasedFromEquipmentCoverageCalclog", "limitAmount"), "decimal(18,0)"),
    JsonField("leased_to_prem", "calculation", ("optionalCoverageCalculation", "f3 <- leasedToEquipmentCoverage"), "decimal(18,0)"),
    JsonField("leased_to_lcm", "calculation", ("optionalCoverageCalculation", "leasedToEquipmentCoverageCalclog", "lcm"), "decimal(10,4)"),
    JsonField("leased_to_loss_cost", "calculation", ("optionalCoverageCalculation", "leasedToEquipmentCoverageCalclog", "lossCost"), "decimal(10,4)"),
    JsonField("leased_to_lim", "calculation", ("optionalCoverageCalculation", "leasedToEquipmentCoverageCalclog", "limitAmount"), "decimal(18,0)"),
    JsonField("loaned_equip_prem", "calculation", ("optionalCoverageCalculation", "f4 <- loanedEquipmentCoverage"), "decimal(18,0)"),
    JsonField("loaned_equip_lcm", "calculation", ("optionalCoverageCalculation", "loanedEquipmentCoverageCalclog", "lcm"), "decimal(10,4)"),
    JsonField("loaned_equip_loss_cost", "calculation", ("optionalCoverageCalculation", "loanedEquipmentCoverageCalclog", "lossCost"), "decimal(10,4)"),
    JsonField("loaned_equip_lim", "calculation", ("optionalCoverageCalculation", "loanedEquipmentCoverageCalclog", "limitAmount"), "decimal(18,0)"),
    JsonField("water_equip_prem", "calculation", ("optionalCoverageCalculation", "f5 <- waterborneEquipmentCoverage"), "decimal(18,0)"),
    JsonField("water_equip_lcm", "calculation", ("optionalCoverageCalculation", "waterborneEquipmentCoverageCalclog", "lcm"), "decimal(10,4)"),
    JsonField("water_equip_loss_cost", "calculation", ("optionalCoverageCalculation", "waterborneEquipmentCoverageCalclog", "lossCost"), "decimal(10,4)", "2.5"),
    JsonField("water_equip_lim", "calculation", ("optionalCoverageCalculation", "waterborneEquipmentCoverageCalclog", "limitAmount"), "decimal(18,0)"),
    JsonField("misc_tools_prem", "calculation", ("optionalCoverageCalculation", "f6 <- miscToolsCoverage"), "decimal(18,0)", "0"),
    JsonField("misc_tools_lcm", "calculation", ("optionalCoverageCalculation", "miscToolsCoverageCalclog", "lcm"), "decimal(10,4)"),
    JsonField("misc_tools_loss_cost", "calculation", ("optionalCoverageCalculation", "miscToolsCoverageCalclog", "lossCost"), "decimal(10,4)", "3.5"),
    JsonField("misc_tools_lim", "quote_package_data", ("coverages", "BASE", "subCoverages", "BLANKET_MISC", "limits", "OCCURRENCE"), "decimal(18,0)", "0", inner=2),
    JsonField("tools_clothes_ca_prem", "calculation", ("optionalCoverageCalculation", "f7 <- employeeToolsClothing"), "decimal(18,0)", "0"),
    JsonField("tools_clothes_ca_emp_lim", "calculation", ("optionalCoverageCalculation", "employeeToolsClothingCalclog", "limitAmount"), "decimal(18,0)", "0"),
    JsonField("tools_clothes_ca_emp_ded", "calculation", ("optionalCoverageCalculation", "employeeToolsClothingCalclog", "deductibleFactor"), "decimal(18,0)"),
    JsonField("tools_clothes_ca_emp_lcm", "calculation", ("optionalCoverageCalculation", "employeeToolsClothingCalclog", "lcm"), "decimal(10,4)"),
    JsonField("tools_clothes_ca_emp_loss_cost", "calculation", ("optionalCoverageCalculation", "employeeToolsClothingCalclog", "lossCostValue"), "decimal(10,4)", "0.01"),
    JsonField("additional_coverage_premium", "calculation", ("finalPremiumCalculation", "additionalCoveragePremium (f2)"), "decimal(18,0)", "0"),
    JsonField("optional_coverage_premium", "calculation", ("finalPremiumCalculation", "optionalCoveragePremium (f3)"), "decimal(18,0)", "0"),
    JsonField("minimum_premium", "calculation", ("finalPremiumCalculation", "minimumPremium"), "decimal(18,0)"),
    JsonField("state_surcharge_rate", "calculation", ("finalPremiumCalculation", "stateSurchargeRate"), "decimal(10,6)"),
)

COVERAGE_FIELDS = (
    JsonField("blanket_equip_occ_lim", "calculation_summary", ("lob specific", "totalResults", "contractors_equipment_limit"), "decimal(18,0)"),
    JsonField("base_premium", "calculation_summary", ("lob specific", "totalResults", "base_premium"), "decimal(18,0)", "0"),
    JsonField("optional_coverage_premium", "calculation_summary", ("lob specific", "totalResults", "optional_coverage_premium"), "decimal(18,0)", "0"),
    JsonField("additional_coverage_premium", "calculation_summary", ("lob specific", "totalResults", "additional_coverage_premium"), "decimal(18,0)", "0"),
    JsonField("blanket_factor", "calculation", ("basePremiumCalculation", "blanketFactor"), "decimal(4,2)", "1.5"),
    JsonField("ded_factor", "calculation", ("basePremiumCalculation", "deductibleFactor"), "decimal(4,2)", "1"),
    JsonField("base_premium_loss_cost", "calculation", ("basePremiumCalculation", "lossCost"), "decimal(4,2)", "2.67"),
    JsonField("base_premium_lcm", "calculation", ("basePremiumCalculation", "lcm"), "decimal(4,2)", "2"),
    JsonField("loss_cost_10K", "calculation", ("basePremiumCalculation", "lossCostOver10K"), "decimal(4,2)", "1.84"),
    JsonField("rewards_limit", "calculation_summary", ("lob specific", "totalResults", "rewards_coverage"), "decimal(18,0)", "0"),
    JsonField("debris_removal_limit", "calculation_summary", ("lob specific", "totalResults", "debris_removal"), "decimal(18,0)", "0"),
    JsonField("false_pretense_limit", "calculation_summary", ("lob specific", "totalResults", "false_pretense"), "decimal(18,0)", "0"),
    JsonField("fire_dpmt_service_limit", "calculation_summary", ("lob specific", "totalResults", "fire_department_service"), "decimal(18,0)", "0"),
    JsonField("fire_extg_systems_limit", "calculation_summary", ("lob specific", "totalResults", "fire_extinguishing_systems"), "decimal(18,0)", "0"),
    JsonField("fuel_acess_limit", "calculation_summary", ("lob specific", "totalResults", "fuel_accessories_spare_parts"), "decimal(18,0)", "0"),
    JsonField("inventory_limit", "calculation_summary", ("lob specific", "totalResults", "inventory_and_appraisal"), "decimal(18,0)", "0"),
    JsonField("polluntant_removal_limit", "calculation_summary", ("lob specific", "totalResults", "pollutant_removal"), "decimal(18,0)", "0"),
    JsonField("trailers_contents_limit", "calculation_summary", ("lob specific", "totalResults", "trailers_and_contents"), "decimal(18,0)", "0"),
    JsonField("employees_tc_limit", "calculation_summary", ("lob specific", "totalResults", "employee_tools_and_clothing_per_occurrence"), "decimal(18,0)", "0"),
    JsonField("borrowed_equip_limit", "calculation_summary", ("lob specific", "totalResults", "borrowed_equipment_limit"), "decimal(18,0)", "0"),
    JsonField("misc_tools_limit", "calculation_summary", ("lob specific", "totalResults", "misc_tools_limit"), "decimal(18,0)", "0"),
    JsonField("rewards_premium", "calculation_summary", ("lob specific", "totalResults", "rewards_coverage_premium"), "decimal(18,0)", "0"),
    JsonField("debris_removal_premiunm", "calculation_summary", ("lob specific", "totalResults", "debris_removal_premium"), "decimal(18,0)", "0"),
    JsonField("false_pretense_premium", "calculation_summary", ("lob specific", "totalResults", "false_pretense_premium"), "decimal(18,0)", "0"),
    JsonField("fire_dpmt_service_premium", "calculation_summary", ("lob specific", "totalResults", "fire_dept_premium"), "decimal(18,0)", "0"),
    JsonField("fire_extg_systems_premium", "calculation_summary", ("lob specific", "totalResults", "fire_extinguishing_service_premium"), "decimal(18,0)", "0"),
    JsonField("fuel_acess_premium", "calculation_summary", ("lob specific", "totalResults", "fuel_accessory_parts_premium"), "decimal(18,0)", "0"),
    JsonField("inventory_premium", "calculation_summary", ("lob specific", "totalResults", "inventory_appraisal_premium"), "decimal(18,0)", "0"),
    JsonField("polluntant_removal_premium", "calculation_summary", ("lob specific", "totalResults", "pollutant_removal_premium"), "decimal(18,0)", "0"),
    JsonField("trailers_contents_premium", "calculation_summary", ("lob specific", "totalResults", "trailers_contents_premium"), "decimal(18,0)", "0"),
    JsonField("employees_tc_premium", "calculation_summary", ("lob specific", "totalResults", "employee_tools_clothing_premium"), "decimal(18,0)", "0"),
)

RATE_CHANGE_FIELDS = (
    JsonField("blanket_factor", "calculation", ("basePremiumCalculation", "blanketFactor"), "decimal(4,2)", "1.5"),
    JsonField("ded_factor", "calculation", ("basePremiumCalculation", "deductibleFactor"), "decimal(4,2)", "1"),
    JsonField("base_premium_loss_cost", "calculation", ("basePremiumCalculation", "lossCost"), "decimal(4,2)", "2.67"),
    JsonField("base_premium_lcm", "calculation", ("basePremiumCalculation", "lcm"), "decimal(4,2)", "2"),
    JsonField("loss_cost_10K", "calculation", ("basePremiumCalculation", "lossCostOver10K"), "decimal(4,2)", "1.84"),
)

# Further fixed paths.
EQUIPMENT_LIMIT = ("lob specific", "totalResults", "contractors_equipment_limit")
SUBCONTRACTOR_COST = ("location.subcontractors_cost",)
FINAL_BASE_PREMIUM = ("finalPremiumCalculation", "basePremium (f1)")
CALCULATED_BASE_PREMIUM = ("basePremiumCalculation", "basePremium")
BORROWED_EQUIPMENT_PREMIUM = ("optionalCoverageCalculation", "f1 <- borrowedEquipmentCoverage")
MISC_TOOLS_PREMIUM = ("optionalCoverageCalculation", "f6 <- miscToolsCoverage")
